"""Spatial joins on grid buckets: equi-joins that Spark can hash and split, with the exact test as a residual."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.sources.scratch import kept, many


def bucket(v: Column, cell: float) -> Column:
    return F.floor(v / F.lit(float(cell))).cast("long")


def around(lo: Column, hi: Column, cell: float) -> Column:
    """The buckets between lo and hi."""
    return F.explode(F.sequence(bucket(lo, cell), bucket(hi, cell)))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float, how: str = "inner") -> DataFrame:
    """Pairs of rows that agree on keys and stand within radius of each other in x and in y.

    left and right have x and y; right's other columns must have other names than left's, and its own x and y come out as
    rx and ry. Right rows go to all buckets within radius (three quarters of them to one or two, as buckets are three times
    as wide), so a left row meets each of its partners once.
    """
    cell = max(3 * float(radius), 1e-9)
    r = right.withColumnsRenamed({"x": "rx", "y": "ry"} | {k: f"__{k}" for k in keys})
    r = r.withColumn("__bx", around(F.col("rx") - radius, F.col("rx") + radius, cell)).withColumn("__by", around(F.col("ry") - radius, F.col("ry") + radius, cell))
    on = (bucket(F.col("x"), cell) == F.col("__bx")) & (bucket(F.col("y"), cell) == F.col("__by"))
    for k in keys:
        on &= F.col(k) == F.col(f"__{k}")
    on &= (F.abs(F.col("x") - F.col("rx")) <= radius) & (F.abs(F.col("y") - F.col("ry")) <= radius)
    return left.join(r, on, how).drop("__bx", "__by", *[f"__{k}" for k in keys])


def least_within(v: np.ndarray, radius: float) -> np.ndarray:
    """The least number u for which v - u, as computed, is radius at most."""
    room = 1e-9 * np.maximum(np.abs(v), max(radius, 1.0))
    out, no = v - radius + room, v - radius - room
    for _ in range(64):
        mid = (out + no) / 2
        fits = v - mid <= radius
        out, no = np.where(fits, mid, out), np.where(fits, no, mid)
    return out


def found_within(places: DataFrame, points: DataFrame, keys: list[str], radius: float, flags: list[str]) -> DataFrame:
    """places (keys, x, y, each once) with flags: whether a point of keys (keys, x, y, flags) that has the flag stands within radius in x and in y.

    radius is positive. Cells are a little narrower than a place's square, so the square ends in another cell than it begins
    in; what it has of a cell is bounded on one side of each axis at most. In order of x, a running maximum of y tells whether
    a point of the cell lies in it. So the work grows with places and points, not with their pairs.
    """
    cell = 2 * radius * (1 - 1e-6)

    @F.pandas_udf("lo double, hi double")
    def square(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"lo": least_within(v.to_numpy(float), radius), "hi": -least_within(-v.to_numpy(float), radius)})

    def sides(s: Column) -> Column:
        """The cells that a square's side touches, and from where on it counts: upwards (sign 1), or downwards in its last cell."""
        lo, hi = bucket(s["lo"], cell), bucket(s["hi"], cell)
        return F.explode(F.transform(F.sequence(lo, hi), lambda c: F.struct(c.alias("cell"), F.when((c == hi) & (c != lo), -1).otherwise(1).alias("sign"), F.when(c == lo, s["lo"]).when(c == hi, -s["hi"]).otherwise(F.lit(-np.inf)).alias("start"))))

    finite = (F.abs("x") < np.inf) & (F.abs("y") < np.inf)
    sign = F.explode(F.array(F.lit(1), F.lit(-1)))
    there = points.where(finite).select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *flags).withColumn("sx", sign).withColumn("sy", sign)
    there = there.groupBy(*keys, bucket(F.col("x"), cell).alias("cx"), bucket(F.col("y"), cell).alias("cy"), "sx", "sy", (F.col("sx") * F.col("x")).alias("from")).agg(*[F.max(F.when(F.col(f), F.col("sy") * F.col("y"))).alias(f) for f in flags])
    asked = places.where(finite).select(*keys, "x", "y", square(F.col("x").cast("double")).alias("u"), square(F.col("y").cast("double")).alias("v"))
    asked = asked.select(*keys, F.struct("x", "y").alias("place"), sides(F.col("u")).alias("u"), "v").select(*keys, "place", "u", sides(F.col("v")).alias("v"))
    asked = asked.select(*keys, "place", F.col("u.cell").alias("cx"), F.col("v.cell").alias("cy"), F.col("u.sign").alias("sx"), F.col("v.sign").alias("sy"), F.col("u.start").alias("from"), F.col("v.start").alias("least"))
    order = W.partitionBy(*keys, "cx", "cy", "sx", "sy").orderBy(F.desc("from"), F.col("place").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = asked.unionByName(there, allowMissingColumns=True).select(*keys, "place", "least", *[F.max(f).over(order).alias(f) for f in flags]).where("place IS NOT NULL")
    return met.groupBy(*keys, "place.x", "place.y").agg(*[F.coalesce(F.bool_or(F.col(f) >= F.col("least")), F.lit(False)).alias(f) for f in flags])


def nearest(cells: DataFrame, points: DataFrame, keys: list[str], farthest: float | None = None) -> DataFrame:
    """cells (keys, x, y and others) with the z of the nearest point (keys, px, py, seq, z); ties go to the smallest seq.

    Each key's first round looks as far as its points are apart on average, in buckets of that size: all points within
    reach of a cell stand in the 3 x 3 buckets around it, so a match within reach is final. What is left looks four times as
    far, and only cells far from every point go on. Rounds end when the widest key's reach spans its cells and points, or at
    farthest: cells without a point so near get null, or one that is not much farther. Keys without points get null.
    Without farthest, cells are taken for many, and points go to the buckets; with it, points are, and cells do.
    """
    names = list(cells.columns)
    box = lambda t, x, y, n: t.groupBy(*keys).agg(*[f(v).alias(f"{n}{k}{i}") for i, v in enumerate((x, y)) for k, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias(f"{n}n"))
    both = box(cells, "x", "y", "c").join(box(points, "px", "py", "p"), keys)
    wide, high = (F.greatest(f"chi{i}", f"phi{i}") - F.least(f"clo{i}", f"plo{i}") for i in (0, 1))
    own = both.withColumn("wide", wide).withColumn("high", high)
    # Points of a line are apart by its length over their number.
    apart = F.greatest(F.sqrt(F.col("wide") * F.col("high") / F.col("pn")), F.greatest("wide", "high") / F.col("pn"), F.lit(1e-9))
    far = F.hypot("wide", "high")
    if farthest is not None:
        apart, far = F.least(apart, F.lit(float(farthest))), F.least(far, F.lit(float(farthest)))
    own = kept(own.select(*keys, apart.alias("__reach"), far.alias("__far")), "reaches")
    rounds = own.agg(F.coalesce(F.max(F.ceil(F.log(4.0, F.greatest(F.lit(1.0), F.col("__far") / F.col("__reach"))))), F.lit(0))).first()[0]
    left, places, done = cells.join(own.drop("__far"), keys, "left"), points.join(own.drop("__far"), keys), None
    around_it = lambda t, b, at: t.withColumn(b, F.explode_outer(F.sequence(at - 1, at + 1)))
    for turn in range(int(rounds) + 1):
        reach = F.col("__reach") * 4.0**turn
        at = lambda v, reach=reach: F.floor(v / reach).cast("long")
        p, c = places, left
        if farthest is None:
            p = around_it(around_it(p, "__bx", at(F.col("px"))), "__by", at(F.col("py")))
            c = c.withColumn("__bx", at(F.col("x"))).withColumn("__by", at(F.col("y")))
        else:
            c = around_it(around_it(c, "__bx", at(F.col("x"))), "__by", at(F.col("y")))
            p = p.withColumn("__bx", at(F.col("px"))).withColumn("__by", at(F.col("py")))
        p = p.select(*keys, "px", "py", "seq", "z", "__bx", "__by")
        d2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
        met = c.join(many(p), [*keys, "__bx", "__by"], "left")
        # Buckets without points have no distance.
        best = met.groupBy(*names, "__reach").agg(F.min(F.when(d2.isNotNull(), F.struct(d2.alias("d2"), F.col("seq"), F.col("z")))).alias("__best"))
        last = turn == rounds
        if not last:
            best = kept(best, "nearest")
        final = F.coalesce(F.col("__best.d2") <= reach * reach, F.lit(False))
        found = (best if last else best.where(final)).select(*names, F.col("__best.z").alias("z"))
        done = found if done is None else done.unionAll(found)
        left = best.where(~final).select(*names, "__reach")
    return done
