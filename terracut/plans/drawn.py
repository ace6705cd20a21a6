"""Queries of scale notes in every spelling, chains of crossing strokes and texts of warnings, with SQL that searches by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracut.functions import text as T
from terracut.operators import layers, layout, scales, strokes
from terracut.plans.fixtures import view, with_views
from terracut.plans.queries import r6
from terracut.plans.stages import LAYOUT, clamped, gray_rows, titles
from terracut.sources.pages import read_pages, write_pages
from terracut.sources.scratch import kept, shared_folder


def note_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets whose notes stand in one span, in neighbours, far apart, out of range, or nowhere."""
    notes = view(spark, sf, "notes")
    return scales.detect_scales(notes, notes.select("sheet_id"))


def note_texts(spark: SparkSession, sf: str) -> DataFrame:
    notes = view(spark, sf, "notes")
    return notes.withColumn("s", T.scale(F.col("text"))).select("sheet_id", "seq", "s.ft_per_inch", "s.confidence", T.may_hold_scale(F.col("text")).alias("hint"))


def outer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Of each sheet's 40 longest strokes the outer ones. A stroke's middle is never outside the hull, so only their number drops any."""
    s = strokes.measured(view(spark, sf, "segments")).select("sheet_id", F.col("seq").alias("chain"), F.col("len").alias("length"), "x1", "y1", "x2", "y2")
    return strokes.keep_outer(strokes.longest(s, 40).drop("rank")).select("sheet_id", "chain", r6("length"))


def crossed_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Every stroke's chain, where neighbouring and crossing lines compete for the same strokes."""
    s = strokes.property_candidates(strokes.measured(view(spark, sf, "crossed")))
    return strokes.chains(s, *strokes.PROPERTY_CHAIN).select("sheet_id", "seq", "chain")


def crossed_walls(spark: SparkSession, sf: str) -> DataFrame:
    b = strokes.building_strokes(strokes.measured(view(spark, sf, "crossed")))
    return b.select("sheet_id", "chain", "members", r6("length"), r6("ang"))


def warning_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings of each sheet, word by word."""
    n = view(spark, sf, "notes").groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("k"))
    s = n.select(
        "sheet_id", F.when(F.col("k") % 3 == 0, "existing").otherwise("proposed").alias("role"), F.when(F.col("k") % 5 == 0, "default").otherwise("pdf_span").alias("scale_source"), F.lit(0).alias("n_legend"), ((F.col("k") / 16) % 4 * 5).cast("int").alias("n_elevations"),
        (F.col("k") % 7).cast("int").alias("n_property"), (F.col("k") % 11 % 2).cast("int").alias("n_building"), F.lit(1).alias("n_polylines"), (F.col("k") % 13 % 4).cast("int").alias("n_associations"), (F.col("k") % 9).cast("int").alias("n_existing_samples"), F.lit(True).alias("computed"), F.lit(True).alias("ok"),
    )
    return layers.stage_status(s).select("sheet_id", F.concat_ws("; ", "warnings").alias("warnings"), *[F.col("status")[k].alias(k) for k in ("scale", "property", "building", "cut_fill")])


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as images and two of them read back, of whose files alone anything is opened; rows that a page lacks are white."""
    folder = shared_folder(spark, "pages")
    write_pages(gray_rows(spark, sf), folder)
    return read_pages(spark, folder).where("sheet_id IN ('G1', 'G3')").select("sheet_id", "y", F.hex("gray").alias("gray"))


#: Ink of a page as conditions on x, y and the sheet's number k: rules of a panel, and pale swatches.
RULES, PALE = "(x + k) % 40 < 2 AND x >= 620 + k % 5 * 30 AND y % 5 < 3", "(x * 3 + k) % 17 = 0 AND x >= 600 + k % 7 * 40 AND y % 11 = 0"


def inked_panels(spark: SparkSession, sf: str) -> DataFrame:
    """Legend panels by texts and by the ink of swatches and rules beside them."""
    sheets = view(spark, sf, "sheets").withColumns({"width_px": F.lit(1000), "height_px": F.lit(1000)})
    rows = sheets.select("sheet_id", F.expr("CAST(substr(sheet_id, 7) AS INT)").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(999))).alias("y"))
    pixels = rows.select("sheet_id", "y", F.expr(f"unhex(concat_ws('', transform(sequence(0, 999), x -> CASE WHEN {RULES} THEN '3C' WHEN {PALE} THEN '96' ELSE 'FF' END)))").alias("gray"))
    spans = titles(spark, sf)
    p = layout.legend_panels(spans, sheets, layout.headers(spans, sheets), kept(pixels, "pages")).where("legend IS NOT NULL")
    return p.select("sheet_id", *[F.col(f"legend.{c}").cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


QUERIES = {f.__name__: f for f in (note_scales, note_texts, outer_lines, crossed_chains, crossed_walls, warning_texts, page_rows, inked_panels)}


def read_sql(text: str) -> str:
    """A scale note's number: of the named pattern if it is possible, else of the bare one."""
    number = lambda pattern: "TRY_CAST(regexp_extract({}, '{}', 1) AS DOUBLE)".format(text, pattern.replace("'", "''"))
    possible = lambda v: f"CASE WHEN {v} BETWEEN 1 AND 200 THEN {v} END"
    return f"coalesce({possible(number(T.NAMED_SCALE))}, {possible(number(T.BARE_SCALE))})"


def chains_sql(fixture: str, part: str, angle: float, sideways: float, gap: float) -> str:
    """WITH RECURSIVE clause of c (sheet_id, chain, seq and the stroke): one stroke joins a sheet's chain in each step, or begins the next chain."""
    across = lambda k: f"abs((y{k}[i] - oy) * ux - (x{k}[i] - ox) * uy)"
    along = lambda k: f"((x{k}[i] - ox) * ux + (y{k}[i] - oy) * uy)"
    return f"""{with_views(fixture).replace('WITH ', 'WITH RECURSIVE ', 1)},
s0 AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len, degrees(atan2(y2 - y1, x2 - x1)) AS a0 FROM fx_{fixture}), s1 AS (SELECT *, a0 - 180 * floor(a0 / 180) AS ang FROM s0 WHERE {part}),
s AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY seq) AS i FROM s1),
arr AS (SELECT sheet_id, count(*) AS n, list(x1 ORDER BY i) AS x1, list(y1 ORDER BY i) AS y1, list(x2 ORDER BY i) AS x2, list(y2 ORDER BY i) AS y2, list(ang ORDER BY i) AS ang FROM s GROUP BY sheet_id),
g(sheet_id, first, joined, members, free) AS (
  SELECT sheet_id, 1::BIGINT, 1::BIGINT, [1::BIGINT], range(2, n + 1) FROM arr
  UNION ALL
  SELECT sheet_id, CASE WHEN c IS NULL THEN free[1] ELSE first END, coalesce(c, free[1]), CASE WHEN c IS NULL THEN [free[1]] ELSE list_append(members, c) END, list_filter(free, lambda i: i <> coalesce(c, free[1]))
  FROM (SELECT *, list_min(list_filter(free, lambda i: least(abs(ang[i] - turn) % 180, 180 - abs(ang[i] - turn) % 180) <= {angle} AND greatest({across(1)}, {across(2)}) <= {sideways}
      AND greatest({along(1)}, {along(2)}) >= lo - {gap} AND least({along(1)}, {along(2)}) <= hi + {gap})) AS c
    FROM (SELECT *, list_min(list_transform(members, lambda i: least({along(1)}, {along(2)}))) AS lo, list_max(list_transform(members, lambda i: greatest({along(1)}, {along(2)}))) AS hi
      FROM (SELECT *, cos(radians(turn)) AS ux, sin(radians(turn)) AS uy
        FROM (SELECT *, list_median(list_transform(members, lambda i: ang[i])) AS turn, list_avg(list_transform(members, lambda i: (x1[i] + x2[i]) / 2)) AS ox, list_avg(list_transform(members, lambda i: (y1[i] + y2[i]) / 2)) AS oy
          FROM g JOIN arr USING (sheet_id) WHERE len(free) > 0)))) ),
c AS (SELECT *, sum(len) OVER (PARTITION BY sheet_id, chain) AS total FROM (SELECT s.*, g.first - 1 AS chain FROM g JOIN s ON s.sheet_id = g.sheet_id AND s.i = g.joined) QUALIFY total >= 40)"""


#: Lines through chains of walls: along the median direction through the mean of all ends.
WALLS = """m AS (SELECT sheet_id, chain, count(*) AS members, median(ang) AS ang, avg((x1 + x2) / 2) AS cx, avg((y1 + y2) / 2) AS cy FROM c GROUP BY ALL),
e AS (SELECT sheet_id, chain, unnest([x1, x2]) AS x, unnest([y1, y2]) AS y FROM c),
r AS (SELECT sheet_id, chain, members, ang, max((x - cx) * cos(radians(ang)) + (y - cy) * sin(radians(ang))) - min((x - cx) * cos(radians(ang)) + (y - cy) * sin(radians(ang))) AS length FROM e JOIN m USING (sheet_id, chain) GROUP BY ALL)
SELECT sheet_id, chain, members, round(length, 6) AS length, round(ang, 6) AS ang FROM r WHERE length >= 45 AND least(ang, 180 - ang, abs(ang - 90)) <= 15 QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY length DESC, chain) <= 50"""
PROPERTY_PART, BUILDING_PART = "color0 <= 0.15 AND w <= 1.4 AND len <= 90", "color0 <= 0.2 AND w >= 1.2 AND len >= 10"

SQL = {
    "note_texts": f"""{with_views('notes')}, t AS (SELECT *, {read_sql('text')} AS v FROM fx_notes)
SELECT sheet_id, seq, v AS ft_per_inch, CASE WHEN v IS NULL THEN NULL WHEN contains(lower(text), 'scale') THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence, regexp_matches(text, '{T.SCALE_HINT}') AS hint FROM t""",
    "note_scales": f"""{with_views('notes')}, near AS (SELECT a.sheet_id, a.seq, b.text, CASE WHEN a.seq = b.seq THEN 0 ELSE abs(a.x - b.x) + abs(a.y - b.y) END AS away, row_number() OVER (PARTITION BY a.sheet_id, a.seq ORDER BY away, a.seq <> b.seq, b.seq) AS k
  FROM fx_notes a JOIN fx_notes b USING (sheet_id) WHERE regexp_matches(a.text, '{T.SCALE_HINT}') AND (a.seq = b.seq OR abs(a.x - b.x) + abs(a.y - b.y) < 160)),
t AS (SELECT sheet_id, 0 AS step, seq, 'pdf_span' AS source, text FROM fx_notes UNION ALL SELECT sheet_id, 1, seq, 'pdf_nearby', string_agg(text, ' ' ORDER BY k) FROM near WHERE k <= 12 GROUP BY sheet_id, seq
  UNION ALL SELECT sheet_id, 2, 0, 'pdf_blob', string_agg(text, ' ' ORDER BY seq) FROM fx_notes GROUP BY sheet_id),
f AS (SELECT *, {read_sql('text')} AS v FROM t), b AS (SELECT * FROM f WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY step, seq) = 1)
SELECT sheet_id, coalesce(v, 10)::DOUBLE AS ft_per_inch, coalesce(source, 'default') AS source, CASE WHEN v IS NULL THEN 0.2 WHEN contains(lower(text), 'scale') THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence FROM (SELECT DISTINCT sheet_id FROM fx_notes) LEFT JOIN b USING (sheet_id)""",
    "outer_lines": f"""{with_views('segments')} SELECT sheet_id, seq AS chain, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) AS length FROM fx_segments
QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) DESC, seq) <= 28""",
    "crossed_chains": f"{chains_sql('crossed', PROPERTY_PART, *strokes.PROPERTY_CHAIN)} SELECT sheet_id, seq, chain FROM c",
    "crossed_walls": f"{chains_sql('crossed', BUILDING_PART, *strokes.BUILDING_CHAIN)}, {WALLS}",
    "building_lines": f"{chains_sql('segments', BUILDING_PART, *strokes.BUILDING_CHAIN)}, {WALLS}",
    "page_rows": f"""{with_views('pixels')}, r AS (SELECT sheet_id, y, string_agg(printf('%02X', v), '' ORDER BY x) AS gray FROM fx_pixels WHERE sheet_id IN ('G1', 'G3') GROUP BY ALL),
a AS (SELECT sheet_id, unnest(range(0, max(y) + 1)) AS y FROM r GROUP BY sheet_id) SELECT sheet_id, CAST(y AS INT) AS y, coalesce(gray, repeat('FF', 40)) AS gray FROM a LEFT JOIN r USING (sheet_id, y)""",
    "inked_panels": f"""{with_views('titles', 'sheets')},{LAYOUT},
bd AS (SELECT sheet_id, CAST(substr(sheet_id, 7) AS INT) AS k, head.x0 AS hx, lft, CAST(floor(greatest(0, top)) AS INT) AS y0, CAST(floor(least(1000, bottom)) AS INT) AS y1, CAST(floor(greatest(1, least(999, lft - 2))) AS INT) AS xr, greatest(0, xr - 120) AS xl FROM sw),
px AS (SELECT *, unnest(range(y0, y1)) AS y FROM (SELECT *, unnest(range(xl, xr)) AS x FROM bd)),
ac AS (SELECT sheet_id, x FROM px GROUP BY sheet_id, x HAVING avg((({RULES}) OR ({PALE}))::INT) > 0.012),
sy AS (SELECT b.*, CAST(floor(greatest(CASE WHEN y1 > y0 + 2 AND xr > xl + 2 AND b.sheet_id IN (SELECT a.sheet_id FROM ac a JOIN bd c USING (sheet_id) WHERE a.x >= c.xr - greatest(12, (c.xr - c.xl) // 8)) THEN (SELECT min(x) FROM ac WHERE ac.sheet_id = b.sheet_id) - 8 ELSE floor(lft - 120 * 0.85) END, hx - 220, 620)) AS INT) AS symbol FROM bd b),
fb AS (SELECT *, greatest(1, least(999, symbol)) AS fr, greatest(0, fr - 50) AS fl FROM sy), fp AS (SELECT *, unnest(range(y0, y1)) AS y FROM (SELECT *, unnest(range(fl, fr)) AS x FROM fb)),
fa AS (SELECT sheet_id, min(x) AS x FROM (SELECT sheet_id, x FROM fp GROUP BY sheet_id, x HAVING avg(({RULES})::INT) > 0.35) GROUP BY sheet_id),
fe AS (SELECT fb.sheet_id, symbol, CAST(floor(greatest(CASE WHEN y1 > y0 + 4 AND fr > fl + 2 AND fa.x IS NOT NULL THEN fa.x ELSE symbol - 20 END, 600, hx - 260)) AS INT) AS frame FROM fb LEFT JOIN fa USING (sheet_id)),
bx AS (SELECT sheet_id, {clamped('greatest(least(frame, symbol) - 10, 580)', 'greatest(0, least(top, head.y0 - 24))', 'least(1000, greatest(rgt, head.x1) + 40)', 'least(1000, greatest(bottom, head.y1 + 80))')} AS legend FROM fe JOIN sw USING (sheet_id))
SELECT sheet_id, CAST(legend.x0 AS INT) AS x0, CAST(legend.y0 AS INT) AS y0, CAST(legend.x1 AS INT) AS x1, CAST(legend.y1 AS INT) AS y1 FROM bx""",
    "warning_texts": f"""{with_views('notes')}, n AS (SELECT sheet_id, min(seq) AS k FROM fx_notes GROUP BY ALL), s AS (SELECT sheet_id, k % 3 = 0 AS old, k % 5 = 0 AS guessed, CAST(floor((k / 16) % 4 * 5) AS INT) AS e, k % 7 AS p, k % 11 % 2 AS b, k % 13 % 4 AS a, k % 9 AS x FROM n)
SELECT sheet_id, concat_ws('; ', CASE WHEN guessed THEN 'scale not found on the sheet' END, CASE WHEN e = 0 THEN 'no elevation callouts in the drawing' END, CASE WHEN p = 0 THEN 'property boundary not traced' END, CASE WHEN b = 0 AND NOT old THEN 'building not detected' END,
  CASE WHEN e > 0 AND a > 0 AND a / e < 0.35 THEN 'few elevations associated with contours' END, CASE WHEN NOT old AND x < 3 THEN 'few existing-surface samples on this sheet' END) AS warnings,
  CASE WHEN guessed THEN 'default' ELSE 'done' END AS scale, CASE WHEN p > 0 THEN 'done' ELSE 'empty' END AS property, CASE WHEN b > 0 THEN 'done' ELSE 'empty' END AS building, CASE WHEN old THEN 'deferred' ELSE 'done' END AS cut_fill FROM s""",
}
