"""Pixel work on tiles of bounded size: ink masks from ridges and local contrast, and thinning to lines one pixel wide.

A tile sees a halo of its neighbours' pixels, wide enough that every pixel comes out as if the page were worked on whole,
whatever the size of tiles. Masks are tables of packed tiles (sheet_id, ty, tx, bits); tiles without ink are not there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.sources.scratch import kept, many

TILE = 256
# Widths of ridges that are looked for, the share of pixels below the ridge threshold, the side of the
# neighbourhood that a pixel is compared with and by how much it must be darker.
SIGMAS, RIDGE_SHARE, NEAR, DARKER = (0.8, 1.2, 1.8, 2.5), 0.9, 31, 8
#: Ridge responses are told apart to this fraction of white.
LEVELS = 1 << 16
#: Reach of the ridge filter (four sigmas), and of contrast: neighbourhood, blur and opening.
HALO = max(int(4 * max(SIGMAS) + 0.5), NEAR // 2 + 3)
#: Thinning passes between two exchanges of halos; each pass reaches two pixels far.
PASSES = 8


def gray_tiles(gray_rows: DataFrame, pages: DataFrame, size: int, halo: int) -> DataFrame:
    """sheet_id, ty, tx, width_px, height_px, rows: the rows (y, gray) of each tile with halo around it, cut at the page's edges."""
    last = lambda n: F.floor((F.col(n) - 1) / size)
    cut = gray_rows.join(pages, "sheet_id")
    for t, at, n in (("ty", F.col("y"), "height_px"),):
        cut = cut.withColumn(t, F.explode(F.sequence(F.greatest(F.lit(0), F.floor((at - halo) / size)), F.least(last(n), F.floor((at + halo) / size)))))
    cut = cut.withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), last("width_px"))))
    first = F.greatest(F.lit(0), F.col("tx") * size - halo).cast("int")
    part = F.substring(F.col("gray"), first + 1, ((F.col("tx") + 1) * size + halo).cast("int") - first)
    return cut.groupBy("sheet_id", "ty", "tx", "width_px", "height_px").agg(F.array_sort(F.collect_list(F.struct("y", part.alias("gray")))).alias("rows"))


def reflected(image: np.ndarray, width: int, before: tuple[bool, bool], after: tuple[bool, bool], mode: str) -> np.ndarray:
    """The image with `width` pixels more where it ends at the page's edge."""
    return np.pad(image, [(width * b, width * a) for b, a in zip(before, after, strict=True)], mode)


def filtered(image: np.ndarray, across: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Separable correlation; pixels whose neighbourhood is not whole come out wrong."""
    out = np.zeros_like(image)
    r = len(across) // 2
    for k, w in enumerate(across):
        out += w * np.roll(image, r - k, 1)
    image, out, r = out, np.zeros_like(image), len(down) // 2
    for k, w in enumerate(down):
        out += w * np.roll(image, r - k, 0)
    return out


def gauss(sigma: float, radius: int, order: int = 0) -> np.ndarray:
    x = np.arange(-radius, radius + 1.0)
    g = np.exp(-x * x / (2 * sigma * sigma))
    g /= g.sum()
    return g if order == 0 else g * -x / sigma**2 if order == 1 else g * (x * x / sigma**4 - 1 / sigma**2)


def ridge_levels(image: np.ndarray) -> np.ndarray:
    """How much each pixel of a gray image (0 to 255) lies on a dark ridge: the greater curvature at its best width, in LEVELS."""
    best = np.zeros(image.shape)
    for sigma in SIGMAS:
        r = int(4 * sigma + 0.5)
        g, d, dd = (gauss(sigma, r, k) for k in range(3))
        g_image = image / 255.0
        xx, yy, xy = filtered(g_image, dd, g), filtered(g_image, g, dd), filtered(g_image, d, d)
        greater = (xx + yy) / 2 + np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        best = np.maximum(best, sigma * sigma * np.maximum(greater, 0))
    return np.minimum(np.floor(best * LEVELS + 1e-6), LEVELS - 1).astype(np.int64)


def local_contrast(image: np.ndarray) -> np.ndarray:
    """Pixels darker than their neighbourhood, where two by two of them stand together."""
    blur = np.floor(filtered(image, *[np.array([0.25, 0.5, 0.25])] * 2) + 0.5)
    near = gauss(0.3 * ((NEAR - 1) * 0.5 - 1) + 0.8, NEAR // 2)
    dark = blur <= np.floor(filtered(blur, near, near) + 0.5) - DARKER
    square = dark & np.roll(dark, -1, 0) & np.roll(dark, -1, 1) & np.roll(dark, (-1, -1), (0, 1))
    return square | np.roll(square, 1, 0) | np.roll(square, 1, 1) | np.roll(square, (1, 1), (0, 1))


def tile_measures(tiles: DataFrame, size: int) -> DataFrame:
    """sheet_id, ty, tx, height and width of each tile, its ridge levels (two bytes a pixel) and its dark pixels (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole = np.array([np.frombuffer(r["gray"], np.uint8) for r in row["rows"]], np.float64)
                y0, x0 = row["ty"] * size, row["tx"] * size
                h, w = min(size, row["height_px"] - y0), min(size, row["width_px"] - x0)
                before, after = (y0 <= HALO, x0 <= HALO), (y0 + h + HALO >= row["height_px"], x0 + w + HALO >= row["width_px"])
                top, left = min(y0, HALO), min(x0, HALO)
                at = (slice(top + HALO * before[0], top + HALO * before[0] + h), slice(left + HALO * before[1], left + HALO * before[1] + w))
                levels = ridge_levels(reflected(whole, HALO, before, after, "symmetric"))[at]
                dark = local_contrast(reflected(whole, HALO, before, after, "edge"))[at]
                yield pa.RecordBatch.from_pylist([{"sheet_id": row["sheet_id"], "ty": row["ty"], "tx": row["tx"], "h": h, "w": w, "levels": levels.astype("<u2").tobytes(), "dark": np.packbits(dark).tobytes()}], pa.schema([("sheet_id", pa.string()), ("ty", pa.int64()), ("tx", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("levels", pa.binary()), ("dark", pa.binary())]))

    return tiles.mapInArrow(run, "sheet_id string, ty long, tx long, h int, w int, levels binary, dark binary")


def level_limits(measures: DataFrame) -> DataFrame:
    """sheet_id, least: the level that RIDGE_SHARE of a sheet's pixels do not exceed (interpolated between two), from counts of levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sheet, levels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                level, n = np.unique(np.frombuffer(levels, "<u2"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([sheet] * len(n), pa.string()), pa.array(level.astype(np.int32)), pa.array(n)], names=["sheet_id", "level", "n"])

    counts = measures.select("sheet_id", "levels").mapInArrow(run, "sheet_id string, level int, n long").groupBy("sheet_id", "level").agg(F.sum("n").alias("n"))
    # At most LEVELS rows a sheet.
    upto = F.sum("n").over(W.partitionBy("sheet_id").orderBy("level").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy("sheet_id"))
    placed = counts.select("sheet_id", "level", upto.alias("upto"), ((total - 1) * RIDGE_SHARE).alias("at"))
    low, high = (F.min(F.when(F.col("upto") > f("at"), F.col("level"))) for f in (F.floor, F.ceil))
    return placed.groupBy("sheet_id").agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("least"))


def ridge_mask(gray_rows: DataFrame, pages: DataFrame, size: int = TILE) -> DataFrame:
    """The runs (sheet_id, y, x0, x1) of ink: pixels on the strongest tenth of a sheet's dark ridges, or in clear local contrast.

    Runs end at tiles' edges. Levels are stored between the two passes, as the threshold needs them all.
    """
    measures = kept(tile_measures(gray_tiles(gray_rows, pages, size, HALO), size), "ridges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                levels = np.frombuffer(r["levels"], "<u2").reshape(r["h"], r["w"])
                dark = np.unpackbits(np.frombuffer(r["dark"], np.uint8), count=levels.size).reshape(levels.shape).astype(bool)
                y, x0, x1 = runs_of((levels >= max(r["least"], 1)) | dark)
                yield pa.RecordBatch.from_arrays([pa.array([r["sheet_id"]] * len(y), pa.string()), *(pa.array((v + o * size).astype(np.int32)) for v, o in ((y, r["ty"]), (x0, r["tx"]), (x1, r["tx"])))], names=["sheet_id", "y", "x0", "x1"])

    return measures.join(F.broadcast(level_limits(measures)), "sheet_id").mapInArrow(run, "sheet_id string, y int, x0 int, x1 int")


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the runs of a mask."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return y, x0, np.nonzero(edge == -1)[1] - 1


def bit_tiles(runs: DataFrame, size: int) -> DataFrame:
    """sheet_id, ty, tx, bits: the tiles that have ink, row by row, eight pixels a byte."""
    parts = runs.select("sheet_id", F.floor(F.col("y") / size).alias("ty"), F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))).alias("tx"), F.col("y") % size, "x0", "x1")
    inside = F.struct((F.col(f"(y % {size})")).alias("y"), F.greatest(F.lit(0), F.col("x0") - F.col("tx") * size).alias("a"), F.least(F.lit(size - 1), F.col("x1") - F.col("tx") * size).alias("b"))
    grouped = parts.groupBy("sheet_id", "ty", "tx").agg(F.collect_list(inside).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for tile in batch.column("runs").to_pylist():
                page = np.zeros((size, size), bool)
                for r in tile:
                    page[r["y"], r["a"] : r["b"] + 1] = True
                bits.append(np.packbits(page).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bits, pa.binary())], names=["sheet_id", "ty", "tx", "bits"])

    return grouped.mapInArrow(run, "sheet_id string, ty long, tx long, bits binary")


def tile_runs(tiles: DataFrame, size: int) -> DataFrame:
    """The runs of packed tiles; they end at tiles' edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sheet, ty, tx, bits in zip(*(batch.column(c).to_pylist() for c in ("sheet_id", "ty", "tx", "bits")), strict=True):
                y, x0, x1 = runs_of(np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(size, size).astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array([sheet] * len(y), pa.string()), *(pa.array((v + o * size).astype(np.int32)) for v, o in ((y, ty), (x0, tx), (x1, tx)))], names=["sheet_id", "y", "x0", "x1"])

    return tiles.mapInArrow(run, "sheet_id string, y int, x0 int, x1 int")


def thin(page: np.ndarray, passes: int) -> np.ndarray:
    """So many passes of Zhang and Suen's thinning; all pixels of a half pass are judged on the same page."""
    page = page.copy()
    for _ in range(passes):
        for first in (True, False):
            p = np.pad(page, 1)
            n, e, s, w = p[:-2, 1:-1], p[1:-1, 2:], p[2:, 1:-1], p[1:-1, :-2]
            ring = [n, p[:-2, 2:], e, p[2:, 2:], s, p[2:, :-2], w, p[:-2, :-2]]
            around = sum(x.astype(np.int8) for x in ring)
            rises = sum((~a & b).astype(np.int8) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
            sides = ~(n & e & s) & ~(e & s & w) if first else ~(n & e & w) & ~(n & s & w)
            page &= ~((around >= 2) & (around <= 6) & (rises == 1) & sides)
    return page


def thinned(tiles: DataFrame, size: int = TILE, passes: int = PASSES) -> DataFrame:
    """Packed tiles (sheet_id, ty, tx, bits) thinned until no pixel changes.

    Each round exchanges halos and makes `passes` passes. Only tiles that changed in the round before, or next to such a
    tile, get halos and work; the rest are carried.
    """
    halo = 2 * passes
    if halo > size:
        raise ValueError(f"tiles of {size} pixels are smaller than the halo of {halo}")
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, changed = [], []
            for tile in batch.column("near").to_pylist():
                page = np.zeros((3 * size, 3 * size), bool)
                for t in tile:
                    page[(t["dy"] + 1) * size : (t["dy"] + 2) * size, (t["dx"] + 1) * size : (t["dx"] + 2) * size] = np.unpackbits(np.frombuffer(t["bits"], np.uint8)).reshape(size, size)
                was = page[size - halo : 2 * size + halo, size - halo : 2 * size + halo]
                now = thin(was, passes)[halo:-halo, halo:-halo]
                out.append(np.packbits(now).tobytes())
                changed.append(bool((now != was[halo:-halo, halo:-halo]).any()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary()), pa.array(changed, pa.bool_())], names=["sheet_id", "ty", "tx", "bits", "changed"])

    key = ["sheet_id", "ty", "tx"]
    state = kept(tiles.select(*key, "bits", F.lit(True).alias("changed")), "tiles")
    while not state.where("changed").isEmpty():
        live = state.where("changed").select("sheet_id", "ty", "tx", F.explode(around).alias("d")).select("sheet_id", (F.col("ty") + F.col("d.dy")).alias("ty"), (F.col("tx") + F.col("d.dx")).alias("tx")).distinct()
        live = kept(live.join(many(state.select(*key)), key, "left_semi"), "live-tiles")
        wanted = live.select(*[F.col(k).alias(f"to_{k}") for k in key], F.explode(around).alias("d"))
        wanted = wanted.select("*", F.col("to_sheet_id").alias("sheet_id"), (F.col("to_ty") + F.col("d.dy")).alias("ty"), (F.col("to_tx") + F.col("d.dx")).alias("tx"))
        near = wanted.join(many(state), key).groupBy(*[F.col(f"to_{k}").alias(k) for k in key]).agg(F.collect_list(F.struct(F.col("d.dy").alias("dy"), F.col("d.dx").alias("dx"), "bits")).alias("near"))
        done = near.mapInArrow(work, "sheet_id string, ty long, tx long, bits binary, changed boolean")
        still = state.join(many(live), key, "left_anti").select(*key, "bits", F.lit(False).alias("changed"))
        state = kept(done.unionByName(still), "tiles")
    return state.select(*key, "bits")
