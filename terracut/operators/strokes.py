"""Vector strokes: property and building lines from chains of collinear segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.functions.geometry import axial_angle, axis_distance, in_bbox, linspace, ring_distance
from terracut.sources.scratch import kept

SEGMENT = ["sheet_id", "seq", "x1", "y1", "x2", "y2", "len", "w", "color0", "ang"]
# Chain tolerances: degrees, pixels sideways, pixels of gap; least total length of a chain.
PROPERTY_CHAIN, BUILDING_CHAIN, LEAST_CHAIN = (7.0, 3.5, 40.0), (6.0, 4.0, 10.0), 40.0


def segments(items: DataFrame, viewport: Column, zoom: Column, matrix: list[Column], pad: float = 8.0) -> DataFrame:
    """SEGMENT rows in page pixels of drawn lines (sheet_id, seq, op, color, width, p1, p2 in points) near the viewport."""
    a, b, c, d, e, f = matrix
    px = lambda p: ((a * F.col(f"{p}.x") + c * F.col(f"{p}.y") + e) * zoom, (b * F.col(f"{p}.x") + d * F.col(f"{p}.y") + f) * zoom)
    drawn = items.where((F.col("op") == "l") & (F.array_min("color") <= 0.55) & (F.hypot(F.col("p1.x") - F.col("p2.x"), F.col("p1.y") - F.col("p2.y")) >= 0.8))
    (x1, y1), (x2, y2) = px("p1"), px("p2")
    s = drawn.select("sheet_id", "seq", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.coalesce("width", F.lit(0.0)).alias("w"), F.col("color")[0].alias("color0"), viewport.alias("__v"))
    grown = F.struct((F.col("__v.x0") - pad).alias("x0"), (F.col("__v.y0") - pad).alias("y0"), (F.col("__v.x1") + pad).alias("x1"), (F.col("__v.y1") + pad).alias("y1"))
    s = s.where(in_bbox((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, grown))
    return measured(s).where("len >= 1.2")


def measured(s: DataFrame) -> DataFrame:
    """SEGMENT rows with length and direction, from sheet_id, seq, x1, y1, x2, y2, w, color0."""
    return s.withColumn("len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).withColumn("ang", axial_angle(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).select(*SEGMENT)


def property_part() -> Column:
    """Thin, dark and short: a SEGMENT row that may be a dash of a property line."""
    return (F.col("color0") <= 0.15) & (F.col("w") <= 1.4) & (F.col("len") <= 90)


def building_part() -> Column:
    """Thick and dark: a SEGMENT row that may be of a wall."""
    return (F.col("color0") <= 0.2) & (F.col("w") >= 1.2) & (F.col("len") >= 10)


def near_border(width: Column, height: Column, margin: float) -> Column:
    """Whether an end of a SEGMENT row stands within margin of the page's edge."""
    x, y = (F.array(F.col(f"{v}1"), F.col(f"{v}2")) for v in "xy")
    return F.exists(x, lambda v: (v < margin) | (v > width - margin)) | F.exists(y, lambda v: (v < margin) | (v > height - margin))


def property_candidates(s: DataFrame) -> DataFrame:
    return s.where(property_part())


def building_candidates(s: DataFrame) -> DataFrame:
    return s.where(building_part())


def chains(s: DataFrame, angle: float, sideways: float, gap: float) -> DataFrame:
    """SEGMENT rows with chain: segments that continue one another, collected greedily in order of seq.

    A segment joins by the chain's median direction and mean point as they are then, so the order decides and a sheet's
    segments are one task's work. Only segments of about the chain's direction and near its line are looked at. Chains below
    LEAST_CHAIN are left out; their segments stay used.
    """

    def build(sheet: pd.DataFrame) -> pd.DataFrame:
        sheet = sheet.sort_values("seq", kind="stable").reset_index(drop=True)
        ends = sheet[["x1", "y1", "x2", "y2"]].to_numpy(float).reshape(-1, 2, 2)
        ang, length, free = sheet["ang"].to_numpy(float), sheet["len"].to_numpy(float), np.ones(len(sheet), bool)
        chain, middle = np.full(len(sheet), -1), ends.mean(axis=1)
        # Segments by direction, in steps of the tolerance; those of a step by where they cross the step's normal.
        step = max(angle, 1e-6)
        steps = max(1, int(180 // step))
        own = np.minimum((ang / 180 * steps).astype(int), steps - 1)
        by_step = []
        for k in range(steps):
            members, turn = np.flatnonzero(own == k), np.radians((k + 0.5) * 180 / steps)
            offset = middle[members] @ np.array([-np.sin(turn), np.cos(turn)])
            order = np.argsort(offset, kind="stable")
            by_step.append((members[order], offset[order], turn))

        def candidates(turn: float, origin: np.ndarray, reach: float) -> np.ndarray:
            """Free segments that may lie along the line: middles no farther from it than sideways, so within a strip of each step."""
            parts, at = [], int(turn / 180 * steps)
            for k in {(at + d) % steps for d in (-2, -1, 0, 1, 2)}:
                members, offset, direction = by_step[k]
                tilt = abs(np.radians(turn) - direction) % np.pi
                wide = (sideways + 1e-6) / max(np.cos(min(tilt, np.pi - tilt)), 1e-6) + reach * np.sin(min(tilt, np.pi - tilt))
                at_origin = origin @ np.array([-np.sin(direction), np.cos(direction)])
                parts.append(members[np.searchsorted(offset, at_origin - wide) : np.searchsorted(offset, at_origin + wide, "right")])
            found = np.concatenate(parts)
            return np.sort(found[free[found]])

        longest = length.max(initial=0.0)
        for seed in range(len(sheet)):
            if not free[seed]:
                continue
            free[seed], members = False, [seed]
            while True:
                turn = np.median(ang[members])
                along = np.array([np.cos(np.radians(turn)), np.sin(np.radians(turn))])
                across = np.array([-along[1], along[0]])
                points = ends[members].reshape(-1, 2)
                origin = points.mean(axis=0)
                reach = (points - origin) @ along
                rest = candidates(turn, origin, np.abs(reach).max() + gap + longest)
                off = np.abs(ang[rest] - turn) % 180
                t = (ends[rest] - origin) @ along
                fits = (np.minimum(off, 180 - off) <= angle) & (np.abs((ends[rest] - origin) @ across).max(axis=1) <= sideways) & (t.max(axis=1) >= reach.min() - gap) & (t.min(axis=1) <= reach.max() + gap)
                if not fits.any():
                    break
                members.append(int(rest[np.argmax(fits)]))
                free[members[-1]] = False
            if length[members].sum() >= LEAST_CHAIN:
                chain[members] = seed
        return sheet.assign(chain=chain)[chain >= 0]

    kind = s.schema["sheet_id"].dataType.simpleString()
    return s.groupBy("sheet_id").applyInPandas(build, f"sheet_id {kind}, seq long, x1 double, y1 double, x2 double, y2 double, len double, w double, color0 double, ang double, chain long")


def chain_lines(members: DataFrame) -> DataFrame:
    """sheet_id, chain, members, ang, length, x1, y1, x2, y2: the line through each chain, from its first to its last reach."""
    ends = members.select("sheet_id", "chain", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    centre = ends.groupBy("sheet_id", "chain").agg(F.avg("p.x").alias("cx"), F.avg("p.y").alias("cy"))
    turn = members.groupBy("sheet_id", "chain").agg(F.median("ang").alias("ang"), F.count(F.lit(1)).alias("members"))
    base = centre.join(turn, ["sheet_id", "chain"])
    ux, uy = F.cos(F.radians("ang")), F.sin(F.radians("ang"))
    t = (F.col("p.x") - F.col("cx")) * ux + (F.col("p.y") - F.col("cy")) * uy
    reach = ends.join(base, ["sheet_id", "chain"]).groupBy("sheet_id", "chain", "members", "ang", "cx", "cy").agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    at = lambda v, c, u: (F.col(c) + F.col(v) * u)
    return reach.select("sheet_id", "chain", "members", "ang", (F.col("hi") - F.col("lo")).alias("length"), at("lo", "cx", ux).alias("x1"), at("lo", "cy", uy).alias("y1"), at("hi", "cx", ux).alias("x2"), at("hi", "cy", uy).alias("y2"))


def property_scores(members: DataFrame) -> DataFrame:
    """sheet_id, chain, score: how much a chain's lengths look like long dashes between short ones.

    Long and short are first taken relative to the median length, and if that leaves too few, by fixed lengths. Chains of
    many pieces of varied length score a little even so.
    """
    key = ["sheet_id", "chain"]
    m = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.median("len").alias("med"), (F.stddev_pop("len") / F.greatest(F.avg("len"), F.lit(1e-3))).alias("cv"), F.collect_list("len").alias("lens"))
    med = F.col("med")
    shorts, longs = F.filter("lens", lambda v: v <= med * 1.3), F.filter("lens", lambda v: v >= F.greatest(med * 2.0, med + 4.0))
    few = (F.size(longs) < 1) | (F.size(shorts) < 2)
    m = m.withColumn("shorts", F.when(few, F.filter("lens", lambda v: v <= 12.0)).otherwise(shorts)).withColumn("longs", F.when(few, F.filter("lens", lambda v: v >= 18.0)).otherwise(longs))

    def middle(values: str) -> Column:
        v, n = F.array_sort(values), F.size(values)
        return (F.try_element_at(v, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(v, F.floor((n + 2) / 2).cast("int"))) / 2

    ratio = middle("longs") / F.greatest(middle("shorts"), F.lit(0.1))
    short_of = (F.size("longs") < 1) | (F.size("shorts") < 2)
    varied = F.when((F.col("n") >= 6) & (F.col("cv") > 0.15), 2.0 + F.least(F.lit(1.0), F.col("n") / 20.0)).otherwise(0.0)
    full = 2.0 + F.when(F.col("n") >= 4, 0.8).otherwise(0.0) + F.when(F.col("cv") >= 0.25, 0.5).otherwise(0.0)
    return m.select(*key, F.when((F.col("n") < 3) | (med <= 0), 0.0).when(short_of, varied).when(ratio.between(2.0, 10.0), full).otherwise(0.0).alias("score"))


def hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hull (ring of structs x, y, from the leftmost lowest corner): the convex hull of each key's points.

    A corner is extreme among the points of its own x, so at most two points for each x reach the task that walks a ring.
    """
    ends = points.groupBy(*keys, F.col("x").cast("double").alias("x")).agg(F.min(F.col("y").cast("double")).alias("lo"), F.max(F.col("y").cast("double")).alias("hi"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("x")
        rims = [list(zip(group.x, group.lo, strict=True)), list(zip(group.x, group.hi, strict=True))[::-1]]
        ring: list[tuple[float, float]] = []
        for rim in rims:
            side: list[tuple[float, float]] = []
            for p in rim:
                while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                    side.pop()
                side.append(p)
            ring += [p for p in side if p not in ring]
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "hull": [[{"x": x, "y": y} for x, y in ring]]})

    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return ends.groupBy(*keys).applyInPandas(walk, f"{kinds}, hull array<struct<x: double, y: double>>")


def densified(lines: DataFrame, spacing: float = 10.0) -> DataFrame:
    """lines with points: evenly spaced from end to end, 8 at least."""
    n = F.greatest(F.lit(8), F.floor(F.col("length") / spacing).cast("int"))
    xy = F.arrays_zip(linspace(F.col("x1"), F.col("x2"), n).alias("x"), linspace(F.col("y1"), F.col("y2"), n).alias("y"))
    return lines.withColumn("points", xy)


def longest(lines: DataFrame, k: int) -> DataFrame:
    return lines.withColumn("rank", F.row_number().over(W.partitionBy("sheet_id").orderBy(F.desc("length"), "chain"))).where(F.col("rank") <= k)


def keep_outer(lines: DataFrame, least: int = 4, most: int = 28) -> DataFrame:
    """Lines of a sheet that are long or lie near the hull of all line ends, longest first; the first `least` if there are none.

    Sheets with `least` lines or fewer keep all.
    """
    ends = lines.select("sheet_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("sheet_id", "p.x", "p.y")
    n = F.count(F.lit(1)).over(W.partitionBy("sheet_id"))
    count = F.greatest(F.lit(8), F.floor(F.col("length") / 10.0).cast("int"))
    share = F.floor(count / 2) / (count - 1)
    near = ring_distance(F.col("x1") + share * (F.col("x2") - F.col("x1")), F.col("y1") + share * (F.col("y2") - F.col("y1")), F.col("hull"))
    all_lines = lines.join(hulls(ends, ["sheet_id"]), "sheet_id").withColumn("n", n).withColumn("fits", (F.col("n") <= least) | (near >= -60.0) | (F.col("length") >= 280))
    order = F.row_number().over(W.partitionBy("sheet_id").orderBy(F.desc("fits"), F.desc("length"), "chain"))
    any_fits = F.max("fits").over(W.partitionBy("sheet_id"))
    return all_lines.withColumn("rank", order).withColumn("any", any_fits).where((F.col("fits") & (F.col("rank") <= most)) | (~F.col("any") & (F.col("rank") <= least))).select(*lines.columns)


def property_strokes(s: DataFrame) -> DataFrame:
    """Property lines (chain_lines() rows): dash-dot chains, the 40 longest, of those the outer ones."""
    members = kept(chains(property_candidates(s), *PROPERTY_CHAIN), "property-chains")
    good = property_scores(members).where("score >= 2.2").select("sheet_id", "chain")
    lines = chain_lines(members).where("length >= 60").join(good, ["sheet_id", "chain"], "left_semi")
    return keep_outer(kept(longest(lines, 40).drop("rank"), "property-lines"))


def building_strokes(s: DataFrame) -> DataFrame:
    """Wall lines (chain_lines() rows): thick chains along an axis, the 50 longest."""
    lines = chain_lines(kept(chains(building_candidates(s), *BUILDING_CHAIN), "wall-chains"))
    return longest(lines.where((F.col("length") >= 45) & (axis_distance(F.col("ang")) <= 15)), 50).drop("rank")
