"""Ink of pages as runs: a sparse bitmap of (sheet_id, y, x0, x1), ends included, on which morphology is interval arithmetic.

A row of a page is the largest group that a task sorts. pages: sheet_id, width_px, height_px.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.sources.scratch import kept, many

# Half widths of the rows of round kernels, from the top row down.
ROUND = {3: (0, 1, 0), 5: (0, 2, 2, 2, 0)}
#: Width of the buckets in which runs of neighbouring rows meet.
BUCKET = 64
#: Rows of a strip whose parts a task labels, and borders of strips that a task joins parts across.
STRIP, FAN = 1024, 64
#: Pixels of the strips in which a task brings a page down, about.
STRIP_PIXELS = 1 << 20


def page_sizes(gray_rows: DataFrame) -> DataFrame:
    return gray_rows.groupBy("sheet_id").agg(F.max(F.length("gray")).alias("width_px"), (F.max("y") + 1).cast("int").alias("height_px"))


def runs_in(row: Column, n: Column, is_ink) -> Column:
    """The runs of the places 0 to n - 1 at which is_ink holds: starts have no ink before them, ends none behind."""
    at = F.filter(F.sequence(F.lit(0), n - 1), is_ink)
    starts, ends = F.array_except(at, F.transform(at, lambda x: x + 1)), F.array_except(at, F.transform(at, lambda x: x - 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("x0"), b.alias("x1")))


def ink_runs(gray_rows: DataFrame, below: int) -> DataFrame:
    """Runs of pixels darker than `below` (1 to 255). Bytes are compared as they are."""
    n = F.length("gray")
    dark = lambda x: F.substring(F.col("gray"), x + 1, F.lit(1)) < F.lit(bytearray([below]))
    return gray_rows.where(n > 0).select("sheet_id", "y", F.inline(runs_in(F.col("gray"), n, dark)))


def merged(runs: DataFrame) -> DataFrame:
    """The union of runs, where they overlap or touch as one."""
    row = W.partitionBy("sheet_id", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(F.col("x0") <= reach + 1, 0).otherwise(1)
    island = runs.withColumn("__begins", begins).withColumn("__island", F.sum("__begins").over(row.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("sheet_id", "y", "__island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__island")


def kernel(size: int, times: int) -> dict[int, int]:
    """Half width for each row of the round kernel applied so many times over."""
    one = {i - size // 2: w for i, w in enumerate(ROUND[size])}
    out = {0: 0}
    for _ in range(times):
        grown: dict[int, int] = {}
        for a, v in out.items():
            for b, w in one.items():
                grown[a + b] = max(grown.get(a + b, 0), v + w)
        out = grown
    return out


def dilated(runs: DataFrame, pages: DataFrame, rows: dict[int, int]) -> DataFrame:
    """Runs widened by the kernel and cut at the page's edges, each row's union."""
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dy, w in sorted(rows.items())]))
    wide = runs.join(pages, "sheet_id").withColumn("k", steps)
    wide = wide.select("sheet_id", (F.col("y") + F.col("k.dy")).alias("y"), F.greatest(F.lit(0), F.col("x0") - F.col("k.w")).alias("x0"), F.least(F.col("width_px") - 1, F.col("x1") + F.col("k.w")).alias("x1"), "height_px")
    return merged(wide.where((F.col("y") >= 0) & (F.col("y") < F.col("height_px"))).drop("height_px"))


def complement(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """The gaps of every row of the pages; runs of a row neither overlap nor touch."""
    rows = pages.where("width_px > 0 AND height_px > 0").select("sheet_id", F.explode(F.sequence(F.lit(0), F.col("height_px") - 1)).alias("y"), F.col("width_px").alias("x0"), F.col("width_px").alias("x1"))
    before = F.lag("x1", 1, -1).over(W.partitionBy("sheet_id", "y").orderBy("x0"))
    gaps = runs.select("sheet_id", "y", "x0", "x1").unionByName(rows).select("sheet_id", "y", (before + 1).alias("x0"), (F.col("x0") - 1).alias("x1"))
    return gaps.where("x0 <= x1")


def closed(runs: DataFrame, pages: DataFrame, size: int, times: int) -> DataFrame:
    """Morphological closing: dilated `times` times, then eroded as often. What is off the page neither adds nor takes ink."""
    rows = kernel(size, times)
    filled = kept(dilated(runs, pages, rows), "dilated")
    return complement(dilated(complement(filled, pages), pages, rows), pages)


def run_id(y: Column, x0: Column) -> Column:
    """A run's number on its page, in reading order."""
    return F.shiftleft(y.cast("long"), 32) + x0


def neighbour_runs(runs: DataFrame) -> DataFrame:
    """sheet_id, u, v: runs of neighbouring rows that touch, corners included."""
    lo, hi = (F.floor((F.col(c) + d) / BUCKET) for c, d in (("x0", -1), ("x1", 1)))
    upper = runs.select("sheet_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), lo.alias("first_a"), F.explode(F.sequence(lo, hi)).alias("bucket"))
    first_b = F.floor(F.col("x0") / BUCKET)
    lower = runs.select("sheet_id", "y", "x0", "x1", first_b.alias("first_b"), F.explode(F.sequence(first_b, F.floor(F.col("x1") / BUCKET))).alias("bucket"))
    pairs = upper.join(many(lower), ["sheet_id", "y", "bucket"]).where("x0 <= a1 + 1 AND x1 >= a0 - 1 AND bucket = greatest(first_a, first_b)")
    return pairs.select("sheet_id", run_id(F.col("y") - 1, F.col("a0")).alias("u"), run_id(F.col("y"), F.col("x0")).alias("v"))


def least_linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in u and v, each once, and the least that each is linked with, over any number of links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (least[a] != least[b]).any():
        np.minimum.at(least, np.maximum(least[a], least[b]), np.minimum(least[a], least[b]))
        while (least[least] != least).any():
            least = least[least]
    return nodes, nodes[least]


def strip_parts(strip: pa.Table) -> pa.Table:
    """The runs of a strip with __part: the number of the first run of their connected part within it."""
    y, x0, x1, ids = (strip[c].to_numpy().astype(np.int64) for c in ("y", "x0", "x1", "__id"))
    order = np.lexsort((x1, x0, y))
    row = lambda y, x: (y << 32) + x + 2
    # In the row above, runs that may touch: those that begin before a run's end, from where one has reached its beginning.
    begins, reached = row(y[order], x0[order]), np.maximum.accumulate(row(y[order], x1[order]))
    first, last = np.searchsorted(reached, row(y - 1, x0 - 1), "left"), np.searchsorted(begins, row(y - 1, x1 + 1), "right")
    n = np.maximum(last - first, 0)
    below = np.repeat(np.arange(len(y)), n)
    above = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    touch = (y[above] == y[below] - 1) & (x1[above] >= x0[below] - 1) & (x0[above] <= x1[below] + 1)
    nodes, least = least_linked(np.concatenate([ids[below[touch]], ids]), np.concatenate([ids[above[touch]], ids]))
    return strip.drop_columns(["__strip"]).append_column("__part", pa.array(least[np.searchsorted(nodes, ids)]))


def merged_parts(links: pa.Table) -> pa.Table:
    """part, label: the least part that each is linked with, where that is another."""
    part, label = least_linked(links["u"].to_numpy(), links["v"].to_numpy())
    other = part != label
    sheet = pa.nulls(0, links.schema.field("sheet_id").type) if not other.any() else links["sheet_id"].combine_chunks()[:1].take(pa.array(np.zeros(other.sum(), np.int64)))
    return pa.table({"sheet_id": sheet, "part": part[other], "label": label[other]})


def labelled(runs: DataFrame) -> DataFrame:
    """runs with label: the number of the first run of its connected part (8 neighbours).

    Tasks label strips of STRIP rows; links across the borders of strips then join parts in strips FAN times as high, and so on.
    A task reads the runs of one strip, or the links across FAN borders, so rounds are few however far a part reaches.
    """
    kind = runs.schema["sheet_id"].dataType.simpleString()
    own = runs.withColumn("__id", run_id(F.col("y"), F.col("x0"))).withColumn("__strip", F.floor(F.col("y") / STRIP))
    own = kept(own.groupBy("sheet_id", "__strip").applyInArrow(strip_parts, own.drop("__strip").schema.add("__part", "long")), "strips")
    part = lambda n: border.select("sheet_id", F.col("__id").alias(f"__{n}"), F.col("__part").alias(n)).distinct()
    border = own.where((F.col("y") % STRIP == 0) | (F.col("y") % STRIP == STRIP - 1))
    met = neighbour_runs(border).withColumnsRenamed({"u": "__u", "v": "__v"})
    links = met.join(many(part("u")), ["sheet_id", "__u"]).join(many(part("v")), ["sheet_id", "__v"])
    # Rows of one strip meet only where strips are two rows high; their parts are one already.
    links = kept(links.where("u <> v").select("sheet_id", F.shiftright("__v", 32).alias("y"), "u", "v").distinct(), "links")
    stars, height = None, STRIP
    while not links.isEmpty():
        height *= FAN
        inside = links.where(F.col("y") % height != 0).groupBy("sheet_id", F.floor(F.col("y") / height))
        found = kept(inside.applyInArrow(merged_parts, f"sheet_id {kind}, part long, label long"), "parts-linked")
        new = lambda n, found=found: many(found.select("sheet_id", F.col("part").alias(n), F.col("label").alias(f"__{n}")))
        links = links.where(F.col("y") % height == 0).join(new("u"), ["sheet_id", "u"], "left").join(new("v"), ["sheet_id", "v"], "left")
        links = kept(links.select("sheet_id", "y", F.coalesce("__u", "u").alias("u"), F.coalesce("__v", "v").alias("v")).distinct(), "links")
        if stars is not None:
            moved = stars.withColumnRenamed("label", "u").join(new("u"), ["sheet_id", "u"], "left")
            found = moved.select("sheet_id", "part", F.coalesce("__u", "u").alias("label")).unionByName(found)
        stars = found
    if stars is None:
        return own.withColumnRenamed("__part", "label").drop("__id")
    stars = stars.withColumnRenamed("part", "__part")
    return own.join(many(stars), ["sheet_id", "__part"], "left").withColumn("label", F.coalesce("label", "__part")).select(*runs.columns, "label")


def part_measures(runs: DataFrame) -> DataFrame:
    """sheet_id, label, area and box of each connected part."""
    return runs.groupBy("sheet_id", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))


def parts_of_area(runs: DataFrame, least: Column, most: Column | None = None) -> DataFrame:
    """The runs (with label) of the parts whose area is within bounds; bounds may name the measures' columns."""
    fits = part_measures(runs).where(F.col("area") >= least)
    if most is not None:
        fits = fits.where(F.col("area") <= most)
    return runs.join(many(fits.select("sheet_id", "label")), ["sheet_id", "label"], "left_semi")


def overlaps(at: np.ndarray, n: int, unit: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, target, overlap) of the source places at with the n target places, in order of targets: sources are unit wide and targets side."""
    low, high = at * unit // side, ((at + 1) * unit - 1) // side
    source = np.concatenate([np.arange(len(at)), np.flatnonzero(high > low)])
    target = np.concatenate([low, high[high > low]])
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    weight = np.minimum((at[source] + 1) * unit, (target + 1) * side) - np.maximum(at[source] * unit, target * side)
    return source[target < n], target[target < n], weight[target < n]


def strip_means(strip: pa.Table, unit: int) -> pa.Table:
    """sheet_id, y, gray of the target rows of a strip, from all source rows that reach into it."""
    side, w, h, high, number = (strip[c][0].as_py() for c in ("side", "w", "h", "__high", "__strip"))
    gray = strip["gray"].combine_chunks()
    length = pc.binary_length(gray).to_numpy()
    pixels = np.zeros((len(gray), int(length.max())), np.int64)
    there = np.arange(pixels.shape[1]) < length[:, None]
    pixels[there] = np.frombuffer(b"".join(gray.to_pylist()), np.uint8)
    x, tx, wx = overlaps(np.arange(pixels.shape[1]), w, unit, side)
    y, ty, wy = overlaps(strip["y"].to_numpy().astype(np.int64), h, unit, side)
    own = ty // high == number
    y, ty, wy = y[own], ty[own], wy[own]
    first = lambda t: np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    sums = []
    for v in (pixels, there.astype(np.int64)):
        across = np.add.reduceat(v[:, x] * wx, first(tx), axis=1) if len(x) else np.zeros((len(v), 0), np.int64)
        sums.append(np.add.reduceat(across[y] * wy[:, None], first(ty), axis=0) if len(y) else np.zeros((0, across.shape[1]), np.int64))
    s, n = sums
    whole = s // np.maximum(n, 1)
    twice = 2 * (s - whole * n)
    mean = (whole + ((twice > n) | ((twice == n) & (whole % 2 == 1)))).astype(np.uint8)
    # Rows may be shorter than the page is wide.
    rows = [m[k > 0].tobytes() for m, k in zip(mean, n, strict=True)]
    some = np.array([len(r) > 0 for r in rows], bool)
    at = ty[first(ty)].astype(np.int32)[some] if len(y) else np.zeros(0, np.int32)
    sheet = strip["sheet_id"].combine_chunks()[:1].take(pa.array(np.zeros(len(at), np.int64)))
    return pa.table({"sheet_id": sheet, "y": pa.array(at, pa.int32()), "gray": pa.array([r for r in rows if r], pa.binary())})


def downscaled(gray_rows: DataFrame, pages: DataFrame, longest: int) -> DataFrame:
    """gray_rows of pages whose longer side is brought down to `longest` pixels by area means; others as they are.

    A target pixel covers side / longest source pixels; overlaps are whole numbers in units of 1 / longest, so means are
    exact, rounded half to even. Tasks take strips of target rows, of some STRIP_PIXELS source pixels.
    """
    long = lambda c: F.col(c).cast("long")
    p = pages.withColumn("side", F.greatest(long("width_px"), long("height_px")))
    p = p.withColumns({k: F.bround(long(f"{v}_px") * longest / F.col("side")).cast("long") for k, v in (("w", "width"), ("h", "height"))})
    p = p.withColumn("__high", F.greatest(F.lit(1), F.floor(F.lit(float(STRIP_PIXELS)) * longest / (F.col("side") * F.greatest(long("width_px"), F.lit(1))))).cast("long"))
    large = gray_rows.where(F.length("gray") > 0).join(p.where(F.col("side") > longest).select("sheet_id", "side", "w", "h", "__high"), "sheet_id")
    low, high = F.expr(f"CAST(y AS BIGINT) * {longest} div side"), F.expr(f"((CAST(y AS BIGINT) + 1) * {longest} - 1) div side")
    strip = F.explode(F.sequence(F.floor(low / F.col("__high")), F.floor(high / F.col("__high"))))
    kind = gray_rows.schema["sheet_id"].dataType.simpleString()
    dealt = large.select("sheet_id", "y", "gray", "side", "w", "h", "__high", strip.alias("__strip"))
    small = dealt.groupBy("sheet_id", "__strip").applyInArrow(lambda t: strip_means(t, longest), f"sheet_id {kind}, y int, gray binary")
    same = gray_rows.join(p.where(F.col("side") <= longest), "sheet_id", "left_semi")
    return same.select("sheet_id", "y", "gray").unionByName(small)
