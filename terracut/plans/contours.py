"""Queries of contours from pixels: runs of ink, closing, connected parts, smaller pages, simpler lines, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.operators import approximate, curved, runs, seeded, tiles, trace
from terracut.plans.fixtures import view, with_views
from terracut.plans.queries import r6
from terracut.plans.stages import gray_rows
from terracut.sources.scratch import kept, many

#: Pixels darker than this are ink in these queries.
INK = 12
#: Longer side of the smaller pages.
LONGEST = 27
LEAST_AREA, MOST_SHARE = 10, 0.04
#: Reach of a seed on these pages, in pixels.
REACH = 6.5


def page_ink(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = gray_rows(spark, sf)
    return runs.ink_runs(rows, INK), runs.page_sizes(rows)


def ink_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of ink of every row of the pages."""
    return page_ink(spark, sf)[0]


def closed_ink(spark: SparkSession, sf: str) -> DataFrame:
    """Ink with its gaps closed, once with each kernel."""
    ink, pages = page_ink(spark, sf)
    both = [runs.closed(ink, pages, size, times).withColumn("kernel", F.lit(size)) for size, times in ((3, 2), (5, 1))]
    return both[0].unionByName(both[1])


def ink_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Connected parts of ink with their areas and boxes."""
    return runs.part_measures(runs.labelled(page_ink(spark, sf)[0]))


def line_ink(spark: SparkSession, sf: str) -> DataFrame:
    """Ink of the parts that may be lines: neither specks nor filled areas."""
    ink, pages = page_ink(spark, sf)
    parts = runs.labelled(ink).join(pages, "sheet_id")
    fits = runs.parts_of_area(parts.drop("width_px", "height_px"), F.lit(LEAST_AREA))
    large = runs.part_measures(fits).join(pages, "sheet_id").where(F.col("area") > F.col("width_px") * F.col("height_px") * MOST_SHARE)
    return fits.join(large.select("sheet_id", "label"), ["sheet_id", "label"], "left_anti").select("sheet_id", "label", "y", "x0", "x1")


def smaller_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = gray_rows(spark, sf)
    return runs.downscaled(rows, runs.page_sizes(rows), LONGEST).select("sheet_id", "y", F.lower(F.hex("gray")).alias("gray"))


def stroke_points(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ink").select("stroke_id", "pos", (F.col("pos") * 3).cast("double").alias("x"), F.floor(F.col("gray") / 8).cast("double").alias("y"))


def simplified_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The points that an approximation of each stroke within 4 pixels needs."""
    return approximate.simplified(stroke_points(spark, sf), ["stroke_id"], 4.0)


def ring_measures(spark: SparkSession, sf: str) -> DataFrame:
    return approximate.ring_measures(stroke_points(spark, sf), ["stroke_id"]).select("stroke_id", "corners", r6("perimeter"), "area")


def thinned_ink(spark: SparkSession, sf: str) -> DataFrame:
    """Closed ink thinned to lines, on tiles of 32 pixels."""
    ink, pages = page_ink(spark, sf)
    return runs.merged(tiles.tile_runs(tiles.thinned(tiles.bit_tiles(runs.closed(ink, pages, 3, 1), 32), 32, 4), 32))


def traced_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines through the pixels of ink."""
    return trace.traced(trace.pixels_of(page_ink(spark, sf)[0]))


def line_pages(spark: SparkSession, sf: str) -> DataFrame:
    """gray_rows of pages with a wavy line for each supplier, twelve rows high; every other line is dashed.

    Numbering leaves a page's lines in one task; they are dealt to all before their pixels are made, once.
    """
    lines = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("P"), F.col("s_suppkey") % 2).alias("sheet_id"), F.col("s_suppkey").alias("key"))
    lines = lines.withColumn("line", F.row_number().over(W.partitionBy("sheet_id").orderBy("key")) - 1).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
    rows = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("dy"))

    @F.pandas_udf("binary")
    def pixels(key: pd.Series, dy: pd.Series) -> pd.Series:
        k, d, x = key.to_numpy(np.int64)[:, None], dy.to_numpy(np.int64)[:, None], np.arange(128)
        wave = 3 + np.abs(np.fmod(x + k * 7, 40) - 20) // 4
        dark = (x >= 10) & (x <= 110) & (d == wave) & ((np.fmod(k, 2) == 0) | (x % 29 >= 1))
        return pd.Series([row.tobytes() for row in np.where(dark, 0x3C, 235 + np.fmod(x * k + d, 8)).astype(np.uint8)])

    return kept(rows.select("sheet_id", (F.col("line") * 12 + F.col("dy")).cast("int").alias("y"), pixels("key", "dy").alias("gray")), "line-pages")


def curved_contours(spark: SparkSession, sf: str) -> DataFrame:
    """Contours of pages with lines, from gray rows to simplified lines."""
    return curved.curved_contours(line_pages(spark, sf), longest=1 << 20, size=64)


def seed_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The line that each run of ink gets when runs claim the lines through their first pixels, longest runs first."""
    ink, _ = page_ink(spark, sf)
    order = W.partitionBy("sheet_id").orderBy(F.col("x0") - F.col("x1"), "y", "x0")
    seeds = ink.select("sheet_id", F.row_number().over(order).alias("rank"), F.col("x0").alias("sx"), F.col("y").alias("sy"), F.lit(REACH).alias("reach"))
    return seeded.claims(seeded.seed_options(seeds, trace.traced(trace.pixels_of(ink)), 8.0))


def seeded_contours(spark: SparkSession, sf: str) -> DataFrame:
    """Contours of pages with lines, claimed by a callout on each line or found without one."""
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("P"), F.col("s_suppkey") % 2).alias("sheet_id"), F.col("s_suppkey").cast("int").alias("seq"), F.when(F.col("s_acctbal") > 5000, "existing_match").otherwise("spot").alias("kind"), F.col("s_nationkey").cast("double").alias("value_ft"))
    line = F.row_number().over(W.partitionBy("sheet_id").orderBy("seq")) - 1
    calls = suppliers.withColumns({"x": F.lit(60.0), "y": line * 12.0 + 5})
    roles = suppliers.select("sheet_id", F.when(F.col("sheet_id") == "P0", "existing").otherwise("auto").alias("role")).distinct()
    points, facts = seeded.seeded_contours(line_pages(spark, sf), calls, roles, longest=1 << 20, size=64)
    return points.join(many(facts.drop("length_px")), ["sheet_id", "poly_seq"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (ink_runs, closed_ink, ink_parts, line_ink, smaller_pages, simplified_lines, ring_measures, thinned_ink, traced_lines, curved_contours, seed_claims, seeded_contours)}


def dilation(name: str, source: str, steps: list[tuple[int, int]]) -> str:
    """Pixels within a kernel's steps of the source's pixels, on the page."""
    moves = ", ".join(f"({dx}, {dy})" for dx, dy in steps)
    return f"{name} AS (SELECT DISTINCT s.sheet_id, s.x + dx AS x, s.y + dy AS y FROM {source} s JOIN pg USING (sheet_id), (VALUES {moves}) k(dx, dy) WHERE s.x + dx BETWEEN 0 AND w - 1 AND s.y + dy BETWEEN 0 AND h - 1)"


def closing(tag: str, steps: list[tuple[int, int]], times: int) -> str:
    """Plain closing, one pass after the other: dilations of ink, then of what is no ink."""
    out, at = [], "ink"
    for k in range(times):
        out.append(dilation(f"{tag}d{k}", at, steps))
        at = f"{tag}d{k}"
    out.append(f"{tag}n AS (SELECT sheet_id, x, y FROM every ANTI JOIN {at} USING (sheet_id, x, y))")
    at = f"{tag}n"
    for k in range(times):
        out.append(dilation(f"{tag}e{k}", at, steps))
        at = f"{tag}e{k}"
    out.append(f"{tag} AS (SELECT sheet_id, x, y FROM every ANTI JOIN {at} USING (sheet_id, x, y))")
    return ", ".join(out)


PIXELS = f"""{with_views('pixels')}, pg AS (SELECT sheet_id, max(x) + 1 AS w, max(y) + 1 AS h FROM fx_pixels GROUP BY ALL),
every AS (SELECT sheet_id, x, y FROM pg, range(w) a(x), range(h) b(y)), ink AS (SELECT sheet_id, x, y FROM fx_pixels WHERE v < {INK})"""
CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
DISC = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if abs(dy) < 2 or dx == 0]


def as_runs(source: str, more: str = "") -> str:
    """Runs of the pixels of a table, by islands of x minus its rank."""
    return f"SELECT sheet_id, {more} CAST(y AS INT) AS y, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY sheet_id, {more} y ORDER BY x) AS island FROM {source}) GROUP BY sheet_id, {more} y, island"


#: Each ink pixel with the least pixel (y, then x) that it reaches.
PARTS = f"""{PIXELS.replace('WITH ', 'WITH RECURSIVE ', 1)}, num AS (SELECT *, y * 4294967296 + x AS id FROM ink),
adj AS (SELECT a.sheet_id, a.id AS a, b.id AS b FROM num a JOIN num b ON a.sheet_id = b.sheet_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND a.id <> b.id),
reach AS (SELECT sheet_id, id AS a, id AS b FROM num UNION SELECT r.sheet_id, r.a, adj.b FROM reach r JOIN adj ON adj.sheet_id = r.sheet_id AND adj.a = r.b),
lab AS (SELECT n.*, label FROM num n JOIN (SELECT sheet_id, a, min(b) AS label FROM reach GROUP BY ALL) l ON l.sheet_id = n.sheet_id AND l.a = n.id),
msr AS (SELECT sheet_id, CAST(label AS BIGINT) AS label, count(*) AS area, CAST(min(x) AS INT) AS x0, CAST(min(y) AS INT) AS y0, CAST(max(x) AS INT) AS x1, CAST(max(y) AS INT) AS y1 FROM lab GROUP BY ALL)"""

# Each edge in both directions, paired where pixels meet; then lists are walked arc by arc. Rings start at their least arc.
TRACED = f"""{PIXELS.replace('WITH ', 'WITH RECURSIVE ', 1)}, dir AS (SELECT * FROM (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)) d(d, dx, dy)),
seen AS (SELECT p.sheet_id, p.x, p.y, d FROM ink p, dir WHERE (p.sheet_id, p.x + dx, p.y + dy) IN (SELECT (sheet_id, x, y) FROM ink)),
outs AS (SELECT s.*, s.y * 16777216::BIGINT + s.x AS pixel FROM seen s WHERE s.d % 2 = 0 OR NOT EXISTS (SELECT 1 FROM seen t WHERE t.sheet_id = s.sheet_id AND t.x = s.x AND t.y = s.y AND t.d IN ((s.d + 7) % 8, (s.d + 1) % 8))),
prs AS (SELECT a.sheet_id, a.pixel, a.d AS a, b.d AS b, (-least((b.d - a.d) % 8, (a.d - b.d + 8) % 8), a.d, b.d) AS o FROM outs a JOIN outs b ON a.sheet_id = b.sheet_id AND a.pixel = b.pixel AND a.d < b.d),
bst AS (SELECT sheet_id, pixel, d, min(o) AS o FROM (SELECT sheet_id, pixel, a AS d, o FROM prs UNION ALL SELECT sheet_id, pixel, b, o FROM prs) GROUP BY ALL),
mut AS (SELECT p.sheet_id, p.pixel, p.a, p.b FROM prs p JOIN bst x ON x.sheet_id = p.sheet_id AND x.pixel = p.pixel AND x.d = p.a AND x.o = p.o JOIN bst z ON z.sheet_id = p.sheet_id AND z.pixel = p.pixel AND z.d = p.b AND z.o = p.o),
wth AS (SELECT sheet_id, pixel, a AS d, b AS w FROM mut UNION ALL SELECT sheet_id, pixel, b, a FROM mut),
arc AS (SELECT o.sheet_id, o.pixel * 8 + o.d AS arc, o.pixel, o.pixel + d1.dy * 16777216 + d1.dx AS ahead, (o.pixel + d1.dy * 16777216 + d1.dx) * 8 + (o.d + 4) % 8 AS rev, (o.pixel + d2.dy * 16777216 + d2.dx) * 8 + (w + 4) % 8 AS before
  FROM outs o JOIN dir d1 ON d1.d = o.d LEFT JOIN wth ON wth.sheet_id = o.sheet_id AND wth.pixel = o.pixel AND wth.d = o.d LEFT JOIN dir d2 ON d2.d = w),
open AS (SELECT sheet_id, arc AS head, arc, 0 AS pos FROM arc WHERE before IS NULL UNION ALL SELECT o.sheet_id, head, arc.arc, pos + 1 FROM open o JOIN arc ON arc.sheet_id = o.sheet_id AND arc.before = o.arc),
rng AS (SELECT * FROM arc ANTI JOIN open USING (sheet_id, arc)),
go AS (SELECT sheet_id, arc AS a, arc AS b FROM rng UNION SELECT g.sheet_id, g.a, rng.arc FROM go g JOIN rng ON rng.sheet_id = g.sheet_id AND rng.before = g.b),
lst AS (SELECT DISTINCT sheet_id, min(b) AS head FROM go GROUP BY sheet_id, a),
around AS (SELECT sheet_id, head, head AS arc, 0 AS pos FROM lst UNION ALL SELECT o.sheet_id, head, arc.arc, pos + 1 FROM around o JOIN arc ON arc.sheet_id = o.sheet_id AND arc.before = o.arc WHERE arc.arc <> head),
al AS (SELECT * FROM open UNION ALL SELECT * FROM around),
one AS (SELECT a.* FROM al a JOIN arc h ON h.sheet_id = a.sheet_id AND h.arc = a.head JOIN al r ON r.sheet_id = a.sheet_id AND r.arc = h.rev WHERE a.head < r.head),
pt AS (SELECT o.sheet_id, head, pos + 1 AS pos, ahead AS place FROM one o JOIN arc ON arc.sheet_id = o.sheet_id AND arc.arc = o.arc UNION ALL SELECT sheet_id, head, 0, head // 8 FROM one WHERE pos = 0)"""
LINES = "SELECT sheet_id, CAST(head AS BIGINT) AS path, CAST(pos AS BIGINT) AS pos, CAST(place % 16777216 AS INT) AS x, CAST(place // 16777216 AS INT) AS y FROM pt"

SQL = {
    "ink_runs": f"{PIXELS} {as_runs('ink')}",
    "closed_ink": f"{PIXELS}, {closing('c3', CROSS, 2)}, {closing('c5', DISC, 1)}, both_ AS (SELECT *, 3 AS kernel FROM c3 UNION ALL SELECT *, 5 FROM c5) {as_runs('both_', 'kernel,')}",
    "ink_parts": f"{PARTS} SELECT * FROM msr",
    "line_ink": f"""{PARTS}, fit AS (SELECT lab.* FROM lab JOIN msr ON msr.sheet_id = lab.sheet_id AND msr.label = lab.label JOIN pg ON pg.sheet_id = lab.sheet_id WHERE area >= {LEAST_AREA} AND area <= w * h * {MOST_SHARE}::DOUBLE)
{as_runs('fit', 'label,')}""",
    "smaller_pages": f"""{PIXELS}, sz AS (SELECT *, greatest(w, h) AS side, CAST(round_even(w * {LONGEST}::DOUBLE / greatest(w, h), 0) AS INT) AS tw, CAST(round_even(h * {LONGEST}::DOUBLE / greatest(w, h), 0) AS INT) AS th FROM pg),
tg AS (SELECT sheet_id, side, X, Y FROM sz, range(tw) a(X), range(th) b(Y) WHERE side > {LONGEST}),
av AS (SELECT g.sheet_id, g.X, g.Y, sum(v * o) AS s, sum(o) AS n FROM (SELECT tg.sheet_id, tg.X, tg.Y, v, (least((q.x + 1) * {LONGEST}, (tg.X + 1) * side) - greatest(q.x * {LONGEST}, tg.X * side)) * (least((q.y + 1) * {LONGEST}, (tg.Y + 1) * side) - greatest(q.y * {LONGEST}, tg.Y * side)) AS o
  FROM tg JOIN fx_pixels q ON q.sheet_id = tg.sheet_id AND q.x * {LONGEST} < (tg.X + 1) * side AND (q.x + 1) * {LONGEST} > tg.X * side AND q.y * {LONGEST} < (tg.Y + 1) * side AND (q.y + 1) * {LONGEST} > tg.Y * side) g GROUP BY ALL)
SELECT sheet_id, CAST(Y AS INT) AS y, string_agg(printf('%02x', CAST(s // n + CASE WHEN 2 * (s % n) > n OR (2 * (s % n) = n AND (s // n) % 2 = 1) THEN 1 ELSE 0 END AS INT)), '' ORDER BY X) AS gray FROM av GROUP BY sheet_id, Y
UNION ALL SELECT sheet_id, y, string_agg(printf('%02x', v), '' ORDER BY x) FROM fx_pixels JOIN sz USING (sheet_id) WHERE side <= {LONGEST} GROUP BY sheet_id, y""",
    "traced_lines": f"{TRACED} {LINES}",
    # Seeds choose one after another: the list of taken lines goes along from rank to rank.
    "seed_claims": f"""{TRACED}, ln AS ({LINES}), px AS (SELECT sheet_id, x, y, list_sort(list_distinct(list(path))) AS paths FROM ln GROUP BY ALL), rn AS ({as_runs('ink')}),
sd AS (SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY x0 - x1, y, x0) AS rank, x0 AS sx, y AS sy FROM rn),
cd AS (SELECT sheet_id, rank, paths, {{'d2': (x - sx) * (x - sx) + (y - sy) * (y - sy), 'y': y, 'x': x, 'path': paths[1]}} AS c FROM sd JOIN px USING (sheet_id) WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) < {REACH * REACH}),
cnt AS (SELECT sheet_id, max(rank) AS n FROM sd GROUP BY ALL),
st AS (SELECT sheet_id, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::STRUCT(d2 INT, y INT, x INT, path BIGINT) AS c FROM cnt
  UNION ALL SELECT sheet_id, k + 1, CASE WHEN c IS NULL THEN taken ELSE list_append(taken, c.path) END, c FROM (
    SELECT s.sheet_id, s.k, any_value(s.taken) AS taken, min(cd.c) FILTER (WHERE NOT list_has_any(cd.paths, s.taken)) AS c FROM st s JOIN cnt ON cnt.sheet_id = s.sheet_id AND s.k < n LEFT JOIN cd ON cd.sheet_id = s.sheet_id AND cd.rank = s.k + 1 GROUP BY s.sheet_id, s.k))
SELECT sheet_id, CAST(k AS INT) AS rank, c.path AS path, c.x AS x, c.y AS y FROM st WHERE c IS NOT NULL""",
    "simplified_lines": f"""{with_views('ink').replace('WITH ', 'WITH RECURSIVE ', 1)}, p AS (SELECT stroke_id, pos, pos * 3 AS x, CAST(floor(gray / 8) AS BIGINT) AS y FROM fx_ink),
seg AS (SELECT stroke_id, min(pos) AS a, max(pos) AS b FROM p GROUP BY ALL
  UNION ALL SELECT stroke_id, unnest([a, s]) AS a, unnest([s, b]) AS b FROM (
    SELECT g.stroke_id, g.a, g.b, arg_max(q.pos, ((pb.x - pa.x) * (q.y - pa.y) - (pb.y - pa.y) * (q.x - pa.x)) ** 2 - q.pos / 1e6) AS s, max(((pb.x - pa.x) * (q.y - pa.y) - (pb.y - pa.y) * (q.x - pa.x)) ** 2) AS far, any_value((pb.x - pa.x) ** 2 + (pb.y - pa.y) ** 2) AS size
    FROM seg g JOIN p pa ON pa.stroke_id = g.stroke_id AND pa.pos = g.a JOIN p pb ON pb.stroke_id = g.stroke_id AND pb.pos = g.b JOIN p q ON q.stroke_id = g.stroke_id AND q.pos > g.a AND q.pos < g.b GROUP BY g.stroke_id, g.a, g.b) WHERE far > 16 * size),
cor AS (SELECT stroke_id, a AS pos FROM seg UNION SELECT stroke_id, b FROM seg)
SELECT stroke_id, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM cor JOIN p USING (stroke_id, pos)""",
    "ring_measures": f"""{with_views('ink')}, p AS (SELECT stroke_id, pos, pos * 3 AS x, CAST(floor(gray / 8) AS BIGINT) AS y FROM fx_ink),
s AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY stroke_id ORDER BY pos))
SELECT stroke_id, count(*) AS corners, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 6) AS perimeter, CAST(abs(sum(x * ny - nx * y)) AS DOUBLE) / 2 AS area FROM s GROUP BY ALL""",
}
