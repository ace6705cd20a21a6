"""Simpler lines: polygon approximation of all lines at once, and measures of rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.sources.scratch import kept, many


def simplified(points: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """The points (keys, pos, x, y) of each line that an approximation within `tolerance` needs, the ends always.

    Farthest-point splitting in rounds: every inner point knows the ends of the stretch that it lies in; each stretch splits
    at its point farthest from the line through its ends (ties: the first), or is done if that is within tolerance. All
    stretches of all lines split in one round, and a long line meets in no task. Where a stretch's ends fall together,
    distances are those from them.
    """
    place = F.struct("pos", "x", "y")
    ends = points.groupBy(*keys).agg(F.min(place).alias("a"), F.max(place).alias("b"))
    corners = [ends.select(*keys, F.col(e)["pos"].alias("pos"), F.col(e)["x"].alias("x"), F.col(e)["y"].alias("y")) for e in ("a", "b")]
    out = corners[0].unionAll(corners[1]).distinct()
    left = kept(points.select(*keys, "pos", "x", "y").join(many(ends), keys).where((F.col("pos") > F.col("a.pos")) & (F.col("pos") < F.col("b.pos"))), "stretches")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    cross = dx * (F.col("y") - F.col("a.y")) - dy * (F.col("x") - F.col("a.x"))
    size = dx * dx + dy * dy
    # Squared distance times the squared length of the stretch, or as it is where the ends fall together.
    far = F.when(size > 0, cross * cross).otherwise((F.col("x") - F.col("a.x")) ** 2 + (F.col("y") - F.col("a.y")) ** 2)
    limit = tolerance * tolerance * F.when(size > 0, size).otherwise(1.0)
    while not left.isEmpty():
        best = left.groupBy(*keys, F.col("a.pos").alias("__a")).agg(F.max(F.struct(far.alias("far"), (-F.col("pos")).alias("first"), place.alias("at"), limit.alias("limit"))).alias("best"))
        splits = kept(best.where("best.far > best.limit").select(*keys, "__a", F.col("best.at").alias("__s")), "splits")
        out = out.unionAll(splits.select(*keys, F.col("__s.pos").alias("pos"), F.col("__s.x").alias("x"), F.col("__s.y").alias("y")))
        inner = left.withColumn("__a", F.col("a.pos")).join(many(splits), [*keys, "__a"]).where(F.col("pos") != F.col("__s.pos"))
        before = F.col("pos") < F.col("__s.pos")
        left = kept(inner.select(*keys, "pos", "x", "y", F.when(before, F.col("a")).otherwise(F.col("__s")).alias("a"), F.when(before, F.col("__s")).otherwise(F.col("b")).alias("b")), "stretches")
    return out


def ring_measures(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, corners, perimeter and area (never negative) of the rings through points in order of pos, closed by the way back."""
    order = W.partitionBy(*keys).orderBy("pos")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in ("x", "y"))
    steps = points.select(*keys, F.hypot(nx - F.col("x"), ny - F.col("y")).alias("step"), (F.col("x") * ny - nx * F.col("y")).alias("twice"))
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("corners"), F.sum("step").alias("perimeter"), (F.abs(F.sum("twice")) / 2).alias("area"))
