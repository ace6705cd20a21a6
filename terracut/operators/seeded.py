"""Contours from seeds: callouts claim lines through the ink of a page in order of rank, with a search without seeds as fallback.

A seed takes the line through its pixel, both ways. Where an earlier one has claimed it, the seed moves to the nearest
pixel within reach that no claimed line covers. Claims are settled in rounds: a seed is sure of its line once no open
seed of lower rank could claim a line through the pixel that it stands on, which is what settling one seed after another
gives. Tasks settle all that can be settled within a cell of a page; the open seed of least rank on every page settles in each round.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.operators import approximate, curved, polylines, raster, tiles, trace
from terracut.operators.polylines import KEY
from terracut.operators.spatial import around, bucket
from terracut.params import DEFAULTS, Params
from terracut.sources.scratch import kept, many

# Longer side of the page worked on, least length, reach of a seed, tolerance of points; kernel that bridges
# dashes and how often; number of lines that the fallback adds at most, and its least lengths as shares.
WORK, LEAST_LENGTH, REACH, TOLERANCE, KERNEL, TIMES = 2200, 40.0, 48.0, 1.2, 5, 4
FALLBACK, FALLBACK_FOUND, FALLBACK_KEPT = 80, 1.4, 1.5
#: Side of the cells of a page whose seeds a task settles, in pixels.
CELL = 512


def seed_options(seeds: DataFrame, points: DataFrame, reach: float = REACH) -> DataFrame:
    """sheet_id, rank, paths, at (d2, y, x): for each seed and set of lines, the nearest pixel on just these lines, nearer than the seed's reach.

    seeds: sheet_id, rank, sx, sy, reach (`reach` at most). points: traced lines. A pixel lies on few lines, eight at most.
    """
    pixels = points.groupBy("sheet_id", "x", "y").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    p = pixels.withColumns({"bx": bucket(F.col("x"), reach), "by": bucket(F.col("y"), reach)})
    s = seeds.select("sheet_id", "rank", "sx", "sy", "reach", around(F.col("sx") - reach, F.col("sx") + reach, reach).alias("bx")).withColumn("by", around(F.col("sy") - reach, F.col("sy") + reach, reach))
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    near = s.join(many(p), ["sheet_id", "bx", "by"]).withColumn("d2", dx * dx + dy * dy).where("d2 < reach * reach")
    return near.groupBy("sheet_id", "rank", "paths").agg(F.min(F.struct("d2", "y", "x")).alias("at"))


def settled(cell: pd.DataFrame) -> pd.DataFrame:
    """rank, path, x, y: the claims of a cell's seeds that no open seed of lower rank, here or in other cells, can disturb.

    cell: rows of seed_options() as rank, d2, y, x, paths; and without d2, a line that a seed of another cell may claim, with the least rank of such seeds.
    """
    abroad = {p[0]: rank for rank, p in cell.loc[cell["d2"].isna(), ["rank", "paths"]].itertuples(index=False)}
    own = cell[cell["d2"].notna()].sort_values(["rank", "d2", "y", "x"], kind="stable")
    taken: set[int] = set()
    open_lines: set[int] = set()
    out = []
    for rank, options in groupby(zip(own["rank"], own["paths"], own["x"], own["y"], strict=True), key=itemgetter(0)):
        free = [o for o in options if taken.isdisjoint(o[1])]
        if not free:
            continue
        _, paths, x, y = free[0]
        if any(p in open_lines or abroad.get(p, rank) < rank for p in paths):
            open_lines.update(o[1][0] for o in free)
        else:
            taken.add(paths[0])
            out.append((rank, paths[0], x, y))
    return pd.DataFrame(out, columns=["rank", "path", "x", "y"]).assign(sheet_id=cell["sheet_id"].iloc[0])


def claims(options: DataFrame, cell: int = CELL) -> DataFrame:
    """sheet_id, rank, path, x, y: the line that each seed gets, as if seeds chose by rank; seeds that get none are left out.

    A seed chooses the nearest pixel (ties: upper, then left) none of whose lines has been claimed, and of that pixel's lines
    the first. Tasks settle the seeds of a cell one after another, so a round ends only where seeds wait for those of other
    cells. The next round's cells lie across the borders of the last; they are twice as wide once a quarter of the options is left.
    """
    seed, line, at = ["sheet_id", "rank"], F.element_at("paths", 1), ["sheet_id", "cy", "cx"]
    home = options.groupBy(*seed).agg(F.min("at").alias("home"))
    waiting = kept(options.join(many(home), seed).select(*seed, "at.*", "paths", F.col("home.y").alias("home_y"), F.col("home.x").alias("home_x")), "options")
    out = options.select(*seed, line.alias("path"), "at.x", "at.y").where("false")
    left, turn = waiting.count(), 0
    before = left
    while left:
        place = lambda c, shift=turn % 2 * (cell // 2), wide=cell: F.floor((F.col(c) + shift) / wide)
        dealt = waiting.select("*", place("home_y").alias("cy"), place("home_x").alias("cx")).drop("home_y", "home_x")
        # The least ranks that may claim a line, of two cells: those of any cell and of any other.
        mine = dealt.groupBy(*at, line.alias("path")).agg(F.min("rank").alias("least"))
        two = mine.groupBy("sheet_id", "path").agg(F.slice(F.sort_array(F.collect_list(F.struct("least", "cy", "cx"))), 1, 2).alias("two"))
        other = F.filter("two", lambda c: (c["cy"] != F.col("cy")) | (c["cx"] != F.col("cx")))
        touched = dealt.select(*at, F.explode("paths").alias("path")).distinct()
        abroad = touched.join(many(two), ["sheet_id", "path"]).select(*at, F.array("path").alias("paths"), F.array_min(other)["least"].alias("rank")).where("rank IS NOT NULL")
        won = kept(dealt.unionByName(abroad, allowMissingColumns=True).groupBy(*at).applyInPandas(settled, out.schema), "claims")
        out = out.unionByName(won)
        rest = waiting.join(many(won.select(*seed)), seed, "left_anti")
        # Only a claim of a lower rank covers an option.
        lower = won.select("sheet_id", "path", F.col("rank").alias("winner"))
        covered = rest.select(*seed, "paths", F.explode("paths").alias("path")).join(many(lower), ["sheet_id", "path"]).where("winner < rank")
        waiting = kept(rest.join(many(covered.select(*seed, "paths")), [*seed, "paths"], "left_anti"), "options")
        left, turn = waiting.count(), turn + 1
        if left <= before / 4:
            before, cell = left, 2 * cell
    return out


def first_come(lines: DataFrame, covers: DataFrame) -> DataFrame:
    """KEY of the lines that stay when each, in order, goes if an earlier one that stays covers it.

    covers: KEY, other_seq, of an earlier line that covers a later one. In rounds: lines without an open earlier cover stay.
    """
    out, waiting = lines.select(*KEY).where("false"), kept(lines.select(*KEY), "open-lines")
    covers = kept(covers.select(*KEY, "other_seq"), "covers")
    while not waiting.isEmpty():
        others = waiting.select("sheet_id", F.col("poly_seq").alias("other_seq"))
        stay = kept(waiting.join(covers.join(others, ["sheet_id", "other_seq"], "left_semi"), KEY, "left_anti"), "staying")
        gone = covers.join(stay.select("sheet_id", F.col("poly_seq").alias("other_seq")), ["sheet_id", "other_seq"], "left_semi")
        out, waiting = out.unionByName(stay), kept(waiting.join(stay, KEY, "left_anti").join(gone, KEY, "left_anti"), "open-lines")
    return out


def renumbered(points: DataFrame) -> DataFrame:
    """KEY, pos, x, y with pos from 0 without gaps."""
    return points.select(*KEY, (F.row_number().over(W.partitionBy(*KEY).orderBy("pos")) - 1).alias("pos"), "x", "y")


def seed_lines(ink: DataFrame, scales: DataFrame, elevations: DataFrame, roles: DataFrame, least_length: float, size: int, params: Params) -> tuple[DataFrame, DataFrame]:
    """The points of the seeds' lines (poly_seq: the seed's rank), in pixels of the page, and their facts."""
    points = curved.page_lines(ink, scales, KERNEL, TIMES, True, size)
    scale = F.col("scale")
    on_page = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") * scale < F.col("width_px")) & (F.col("y") * scale < F.col("height_px"))
    e = elevations.join(scales, "sheet_id").where(on_page).select(*elevations.columns)
    pixels = points.join(scales, "sheet_id").select("sheet_id", (F.col("x") / scale).alias("x"), (F.col("y") / scale).alias("y")).distinct()
    seeds = kept(raster.select_seeds(e, pixels, roles, REACH), "seeds")
    work = seeds.join(scales, "sheet_id").select("sheet_id", "rank", *[F.round(F.col(c) * scale).cast("int").alias(c) for c in ("sx", "sy")], (REACH * scale).alias("reach"))
    won = claims(seed_options(work, points)).select("sheet_id", "rank", "path")
    lengths = trace.line_lengths(points.join(many(won), ["sheet_id", "path"])).join(scales, "sheet_id").where(F.col("length") >= least_length * scale)
    long_ones = won.join(many(lengths.select("sheet_id", "path", "scale", (F.col("length") / scale).alias("length_px"))), ["sheet_id", "path"])
    facts = kept(long_ones.join(many(seeds.select("sheet_id", "rank", F.col("kind").alias("label_kind"), "z")), ["sheet_id", "rank"]).withColumnRenamed("rank", "poly_seq"), "seeded")
    lines = points.join(many(facts.select(*KEY, "path")), ["sheet_id", "path"]).select(*KEY, "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    corners = renumbered(approximate.simplified(lines, KEY, TOLERANCE)).join(scales.select("sheet_id", "scale"), "sheet_id")
    corners = kept(corners.select(*KEY, "pos", (F.col("x") / scale).alias("x"), (F.col("y") / scale).alias("y")), "seeded-points")
    # Straight strokes are no contours where the sheet's role is not known.
    shapes = polylines.metrics(corners).join(roles, "sheet_id").where((F.col("role") != "auto") | (polylines.shape_class() != "structure"))
    facts = facts.join(many(shapes.select(*KEY)), KEY, "left_semi").select(*KEY, "label_kind", "z", "length_px")
    stay = kept(polylines.merge_same_level(corners.join(many(facts.select(*KEY)), KEY, "left_semi"), facts.select(*KEY, "z", "length_px"), params), "levels")
    return corners.join(many(stay), KEY, "left_semi"), facts.join(many(stay), KEY, "left_semi")


def seeded_contours(gray_rows: DataFrame, elevations: DataFrame, roles: DataFrame, allowed: DataFrame | None = None, longest: int = WORK, least_length: float = LEAST_LENGTH, fallback: bool = True, size: int = tiles.TILE, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Points (KEY, pos, x, y in pixels of the page) and facts (KEY, source, label_kind, z, length_px) of the contours of pages.

    elevations: sheet_id, seq, kind, value_ft, x, y on the pages given; roles: sheet_id, role. Lines that callouts claim come
    first; of one level, those along the longest go. With fallback, lines found without seeds are added, the best FALLBACK of a page,
    unless they run along another. poly_seq numbers a page's contours by length and turn, best first. Pages without callouts have
    fallback lines alone; without ink, nothing.
    """
    ink, pages = curved.page_ink(gray_rows, allowed, longest, size)
    points, facts = seed_lines(ink, pages, elevations, roles, least_length, size, params)
    facts = facts.withColumn("source", F.lit("seeded"))
    if fallback:
        # Negative numbers keep them apart from seeds' ranks.
        more = kept(renumbered(curved.contours_of(ink, pages, FALLBACK_FOUND * least_length, size).withColumn("poly_seq", -1 - F.col("poly_seq"))), "fallback")
        best = polylines.top(polylines.metrics(more), polylines.curve_score(), FALLBACK).where(F.col("length_px") >= FALLBACK_KEPT * least_length)
        best = kept(best.select(*KEY, "length_px", "rank"), "best")
        every = kept(points.unionByName(more.join(many(best.select(*KEY)), KEY, "left_semi")), "all-points")
        along = kept(polylines.near_shares(every, params).where((F.col("share") >= params.redundant_share) & (F.col("poly_seq") < 0)).select(*KEY, "other_seq"), "along")
        left = best.join(along.where("other_seq >= 0"), KEY, "left_anti")
        order = best.select("sheet_id", F.col("poly_seq").alias("other_seq"), F.col("rank").alias("other_rank"))
        covers = along.join(best, KEY).join(order, ["sheet_id", "other_seq"]).where("other_rank < rank")
        stay = first_come(left, covers)
        facts = facts.unionByName(best.join(stay, KEY, "left_semi").select(*KEY, "length_px", F.lit("skeleton_fallback").alias("source")), allowMissingColumns=True)
        points = every.where("poly_seq >= 0").unionByName(every.join(stay, KEY, "left_semi"))
    score = polylines.metrics(points).withColumn("score", polylines.curve_score())
    numbers = F.row_number().over(W.partitionBy("sheet_id").orderBy(F.desc("score"), "poly_seq"))
    names = kept(score.select(*KEY, numbers.alias("number")), "numbers")
    named = lambda d: d.join(many(names), KEY).withColumn("poly_seq", F.col("number")).drop("number")
    return named(points).select(*KEY, "pos", "x", "y"), named(facts).select(*KEY, "source", "label_kind", "z", "length_px")
