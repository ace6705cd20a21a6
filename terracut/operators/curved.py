"""Contours of pages without seeds: from gray rows to simplified lines, every step over all pages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracut.operators import approximate, raster, runs, tiles, trace
from terracut.sources.scratch import kept, many

# The longer side of a page that is worked on, the least length of a contour and the tolerance of its points
# (in pixels of the page worked on), the kernel that bridges dashes and how often.
WORK, LEAST_LENGTH, TOLERANCE, KERNEL, TIMES = 1800, 55.0, 1.1, 3, 2


def page_ink(gray_rows: DataFrame, allowed: DataFrame | None, longest: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Runs of ink of the pages worked on, brought to `longest`, by ridges and contrast; and sheet_id, width_px, height_px, scale of these pages.

    allowed: runs (sheet_id, y, x0, x1) of the page worked on where ink may be; none: everywhere.
    """
    full = kept(runs.page_sizes(gray_rows), "page-sizes")
    small = kept(runs.downscaled(gray_rows, full, longest), "work-pages")
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest("full_w", "full_h"))
    whole = full.select("sheet_id", F.col("width_px").alias("full_w"), F.col("height_px").alias("full_h"))
    pages = kept(runs.page_sizes(small).join(whole, "sheet_id").withColumn("scale", scale).drop("full_w", "full_h"), "work-sizes")
    ink = tiles.ridge_mask(small, pages.drop("scale"), size)
    return kept(runs.merged(ink if allowed is None else both(ink, allowed)), "page-ink"), pages


def page_lines(ink: DataFrame, pages: DataFrame, kernel: int, times: int, seeded: bool, size: int) -> DataFrame:
    """Lines (sheet_id, path, pos, x, y) through page_ink(): gaps of dashes are closed, specks (and without seeds filled areas)
    dropped, the rest thinned and traced."""
    parts = kept(runs.labelled(kept(runs.closed(ink, pages.drop("scale"), kernel, times), "closed-ink")), "parts")
    measured = runs.part_measures(parts).join(pages, "sheet_id")
    lines = raster.component_area_limits(measured, F.col("scale"), F.col("width_px"), F.col("height_px"), seeded)
    clean = parts.join(many(lines.select("sheet_id", "label")), ["sheet_id", "label"], "left_semi")
    skeleton = tiles.tile_runs(tiles.thinned(tiles.bit_tiles(clean, size), size, min(tiles.PASSES, size // 2)), size)
    return kept(trace.traced(trace.pixels_of(skeleton)), "traced")


def contours_of(ink: DataFrame, pages: DataFrame, least_length: float, size: int) -> DataFrame:
    """curved_contours() of the ink that page_ink() found."""
    points, scales = page_lines(ink, pages, KERNEL, TIMES, False, size), pages.select("sheet_id", "scale")
    long_ones = trace.line_lengths(points).join(scales, "sheet_id").where(F.col("length") >= least_length * F.col("scale"))
    points = points.join(many(long_ones.select("sheet_id", "path")), ["sheet_id", "path"])
    key = points.select("sheet_id", F.col("path").alias("poly_seq"), "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    corners = approximate.simplified(key, ["sheet_id", "poly_seq"], TOLERANCE)
    return corners.join(scales, "sheet_id").select("sheet_id", "poly_seq", "pos", (F.col("x") / F.col("scale")).alias("x"), (F.col("y") / F.col("scale")).alias("y"))


def curved_contours(gray_rows: DataFrame, allowed: DataFrame | None = None, longest: int = WORK, least_length: float = LEAST_LENGTH, size: int = tiles.TILE) -> DataFrame:
    """sheet_id, poly_seq, pos, x, y: contours found on pages (sheet_id, y, gray), in pixels of the page.

    Lines through the ink of least_length stay, simplified. poly_seq is the number of a line's first edge.
    """
    return contours_of(*page_ink(gray_rows, allowed, longest, size), least_length, size)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """The runs that two tables of runs have in common."""
    other = b.select("sheet_id", "y", F.col("x0").alias("__0"), F.col("x1").alias("__1"))
    met = a.join(many(other), ["sheet_id", "y"]).where("x0 <= __1 AND x1 >= __0")
    return met.select("sheet_id", "y", F.greatest("x0", "__0").alias("x0"), F.least("x1", "__1").alias("x1"))
