"""Polylines as rows of points: shape metrics, classes, sampling, redundancy and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.functions.geometry import stride, turn_angle
from terracut.operators import alongside
from terracut.operators.spatial import around, bucket
from terracut.params import DEFAULTS, Params
from terracut.sources.scratch import kept, many

KEY = ["sheet_id", "poly_seq"]


def metrics(points: DataFrame) -> DataFrame:
    """KEY, n_points, length_px, chord, straightness, mean_abs_turn, dx, dy (first to last point) of each polyline.

    points: KEY, pos, x, y. Under two points a polyline is straight without a turn.
    """
    w = W.partitionBy(*KEY).orderBy("pos")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    step = points.select(*KEY, "pos", x.alias("x"), y.alias("y")).withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dy", F.col("y") - F.lag("y").over(w))
    turn = turn_angle(F.lag("dx").over(w), F.lag("dy").over(w), F.col("dx"), F.col("dy"))
    m = step.withColumn("turn", turn).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.coalesce(F.sum(F.hypot("dx", "dy")), F.lit(0.0)).alias("length_px"),
        (F.max_by("x", "pos") - F.min_by("x", "pos")).alias("dx"),
        (F.max_by("y", "pos") - F.min_by("y", "pos")).alias("dy"),
        F.coalesce(F.avg("turn"), F.lit(0.0)).alias("mean_abs_turn"),
    )
    chord = F.hypot("dx", "dy")
    return m.select(*KEY, "n_points", "length_px", chord.alias("chord"), F.when(F.col("n_points") < 2, 1.0).otherwise(chord / F.greatest("length_px", F.lit(1e-3))).alias("straightness"), "mean_abs_turn", "dx", "dy")


def shape_class() -> Column:
    """structure or topo, of metrics() rows: long straight strokes, along an axis or very straight ones, are structure."""
    angle = F.pmod(F.abs(F.degrees(F.atan2("dy", "dx"))), F.lit(180.0))
    axis = F.least(angle, F.abs(F.lit(90.0) - angle), F.abs(F.lit(180.0) - angle)) < 10
    straight, length = F.col("straightness"), F.col("length_px")
    return (
        F.when(F.col("n_points") < 2, "structure")
        .when(F.col("mean_abs_turn") >= 0.10, "topo")
        .when((straight > 0.93) & axis & (length > 90), "structure")
        .when((straight > 0.985) & (length > 140), "structure")
        .otherwise("topo")
    )


def coarse_style(kind: Column) -> Column:
    """topo_curve, contour_dash, property_dashdot or building_solid, of metrics() rows with a kind."""
    long_straight = (F.col("straightness") > 0.92) & (F.col("length_px") > 120)
    return (
        F.when((F.col("mean_abs_turn") >= 0.12) | ~long_straight, "topo_curve")
        .when(kind == "existing", "contour_dash")
        .when(kind == "property", "property_dashdot")
        .when(kind.isin("building", "structure") | (F.col("straightness") > 0.98), "building_solid")
        .otherwise("property_dashdot")
    )


def strided(points: DataFrame, k: int) -> DataFrame:
    """About k points of each polyline: every (n div k)-th, from the first."""
    n = F.count(F.lit(1)).over(W.partitionBy(*KEY))
    return points.withColumn("__n", n).where(F.col("pos") % stride(F.col("__n"), k) == 0).drop("__n")


def near_shares(points: DataFrame, params: Params = DEFAULTS, groups: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """KEY, other_seq, share: the part of a polyline's samples that lie within redundant_reach of another's vertices.

    Samples meet the vertices in the buckets within reach; each sample counts once for each other polyline. groups: KEY,
    group, primary: then polylines that are not their group's primary meet that one alone. others: KEY of the polylines whose
    vertices count; none: all.
    """
    reach, cell = params.redundant_reach, 3 * params.redundant_reach
    n = F.count(F.lit(1)).over(W.partitionBy(*KEY))
    by = ["sheet_id"]
    if groups is not None:
        points, by = points.join(many(groups), KEY), ["sheet_id", "group"]
    sized = points.withColumn("__n", n).where("__n >= 2").select(*points.columns, "__n")
    samples, vertices = sized, sized
    if groups is not None:
        samples, vertices = sized.where("poly_seq != primary"), sized.where("poly_seq = primary")
    if others is not None:
        vertices = vertices.join(many(others), KEY, "left_semi")
    samples = samples.where(F.col("pos") % stride(F.col("__n"), params.redundant_samples) == 0)
    step = stride(F.col("__n"), params.redundant_samples)
    samples = samples.select(*by, "poly_seq", "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.ceil(F.col("__n") / step).alias("samples"))
    vertices = vertices.select(*by, F.col("poly_seq").alias("other_seq"), F.col("x").cast("double").alias("vx"), F.col("y").cast("double").alias("vy"))
    vertices = vertices.withColumn("__bx", around(F.col("vx") - reach, F.col("vx") + reach, cell)).withColumn("__by", around(F.col("vy") - reach, F.col("vy") + reach, cell))
    met = samples.withColumn("__bx", bucket(F.col("x"), cell)).withColumn("__by", bucket(F.col("y"), cell)).join(many(vertices), [*by, "__bx", "__by"])
    met = met.where((F.col("poly_seq") != F.col("other_seq")) & (F.hypot(F.col("x") - F.col("vx"), F.col("y") - F.col("vy")) < reach))
    return met.groupBy(*KEY, "other_seq", "samples").agg((F.count_distinct("pos") / F.col("samples")).alias("share")).drop("samples")


def redundant(points: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """KEY of the polylines that run along another one, found in tasks; only very long ones meet all samples in a join."""
    lines = kept(alongside.lines_of(points, params), "lines")
    found = alongside.beside_short_ones(lines, params)
    others = lines.where(F.col("n") > alongside.LONG).select(*KEY)
    if not others.isEmpty():
        every = lines.select(*KEY, F.inline("points"))
        found = found.unionByName(near_shares(every, params, others=others).where(F.col("share") >= params.redundant_share).select(*KEY))
    return found.distinct()


def merge_same_level(points: DataFrame, levels: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """KEY of the polylines that stay when those of one elevation (to 0.01) that run along its longest are dropped.

    levels: KEY, z (may be null), length_px. Polylines without an elevation stay; only the longest drops others, so only
    its vertices are looked at.
    """
    order = W.partitionBy("sheet_id", "level").orderBy(F.desc("length_px"), "poly_seq")
    ranked = levels.withColumn("level", F.bround("z", 2)).withColumn("primary", F.first("poly_seq").over(order))
    alone = F.count(F.lit(1)).over(W.partitionBy("sheet_id", "level")) > 1
    groups = ranked.where("level IS NOT NULL").withColumn("__more", alone).where("__more").select(*KEY, F.col("level").alias("group"), "primary")
    dropped = near_shares(points, params, groups).where(F.col("share") >= params.redundant_share).select(*KEY)
    return ranked.select(*KEY).join(many(dropped), KEY, "left_anti")


def top(rows: DataFrame, score: Column, k: int) -> DataFrame:
    """The k rows of each sheet with the highest score, first poly_seq first among equals, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("sheet_id").orderBy(score.desc(), "poly_seq"))).where(F.col("rank") <= k)


def curve_score() -> Column:
    return F.col("length_px") * (F.lit(1.0) + 2.0 * F.col("mean_abs_turn"))
