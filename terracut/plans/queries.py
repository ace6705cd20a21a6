"""One query for each plan-sheet operator over the fixture views, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracut.functions import geometry as G
from terracut.functions import text as T
from terracut.operators import associate, elevations, layers, layout, polylines, scales, site, strokes, styles, surfaces, volumes
from terracut.operators.elevations import with_context
from terracut.params import DEFAULTS
from terracut.plans import cutfill
from terracut.plans.fixtures import view, with_views

GRID, FUSED_GRID = DEFAULTS.grid_n, DEFAULTS.fused_grid_n


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def r3(c: str) -> Column:
    """Volumes are sums of some thousand cells, whose order shows in the ninth digit."""
    return F.round(c, 3).alias(c)


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    spans = view(spark, sf, "spans").join(view(spark, sf, "sheets"), "sheet_id")
    return elevations.read_elevations(spans, F.col("role"))


def site_volumes(spark: SparkSession, sf: str, grid_n: int = GRID) -> DataFrame:
    """Flagship: cut and fill of every site, from surfaces triangulated on one grid each."""
    s = view(spark, sf, "samples")
    v = cutfill.single_sheet_volumes(s, s, replace(DEFAULTS, grid_n=grid_n))
    return v.select("site_id", r3("cut_cy"), r3("fill_cy"), r3("net_cy"), "ok", "message", "cell_count")


def nearest_volumes(spark: SparkSession, sf: str, grid_n: int = GRID) -> DataFrame:
    grid = surfaces.build_surfaces(view(spark, sf, "samples"), grid_n, method="nearest")
    v = volumes.cut_fill(grid, ["site_id"])
    return v.select("site_id", r3("cut_cy"), r3("fill_cy"), "ok", "cell_count")


def volume_scores(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "samples").groupBy("site_id").agg(F.sum(F.when(F.col("surface") == "existing", F.col("z"))).alias("cut_cy"), F.sum(F.when(F.col("surface") == "proposed", F.col("z"))).alias("fill_cy"))
    e = volumes.evaluate(v, view(spark, sf, "truth"), ["site_id"])
    return e.select("site_id", r6("cut_abs_error"), r6("fill_abs_error"), r6("cut_pct_error"), r6("fill_pct_error"), r6("net_abs_error"), "within_tolerance")


def score_texts(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "samples").groupBy("site_id").agg(F.count_if(F.col("surface") == "existing").cast("double").alias("cut_cy"), F.count_if(F.col("surface") == "proposed").cast("double").alias("fill_cy"))
    truth = v.select("site_id", (F.col("cut_cy") * 2).alias("cut_cy"), F.lit(0.0).alias("fill_cy"))
    return volumes.score_table(volumes.evaluate(v, truth, ["site_id"]))


def grid_extents(spark: SparkSession, sf: str, grid_n: int = GRID) -> DataFrame:
    e = surfaces.extents(view(spark, sf, "samples"), grid_n, 0.05)
    return e.select("site_id", *[r6(c) for c in ("x0", "y0", "dx", "dy", "cell_ft")])


def fused_samples(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "samples").withColumn("x_ft", F.col("x_ft") - 500).withColumn("y_ft", F.col("y_ft") - 500)
    f = surfaces.fuse_samples(s, s, view(spark, sf, "frames"))
    return f.select("site_id", "surface", "seq", r6("x_ft"), r6("y_ft"), "z")


def fused_volumes(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "samples").withColumn("x_ft", F.col("x_ft") - 500).withColumn("y_ft", F.col("y_ft") - 500)
    f = view(spark, sf, "frames")
    v, _ = cutfill.fused_volumes((s, f.select("site_id", F.col("pw").alias("w"), F.col("ph").alias("h"))), (s, f.select("site_id", F.col("ew").alias("w"), F.col("eh").alias("h"))))
    return v.select("site_id", r3("cut_cy"), r3("fill_cy"), "ok", "cell_count")


def elevation_context(spark: SparkSession, sf: str) -> DataFrame:
    return with_context(view(spark, sf, "spans"), F.col("text").startswith("EL"), 70.0).select("sheet_id", "seq", "context")


def elevation_readings(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("sheet_id", "seq", "value_ft", "confidence", "kind")


def ocr_readings(spark: SparkSession, sf: str) -> DataFrame:
    spans = view(spark, sf, "spans").join(view(spark, sf, "sheets"), "sheet_id").withColumn("score", (F.col("seq") % 10) / 10.0)
    return elevations.ocr_elevations(spans, F.col("role")).select("sheet_id", "seq", "value_ft", r6("confidence"), "kind")


def elevations_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Deduped callouts, floor levels as one, without outliers."""
    d = elevations.dedupe(parsed(spark, sf))
    return elevations.drop_outliers(elevations.collapse_pad_levels(d)).select("sheet_id", "seq", "value_ft", "confidence", "kind")


def pad_levels(spark: SparkSession, sf: str) -> DataFrame:
    coarse = parsed(spark, sf).withColumn("value_ft", F.floor(F.col("value_ft") / 20) * 20.0)
    return elevations.collapse_pad_levels(coarse).select("sheet_id", "seq", "value_ft", "confidence", "kind")


def elevation_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return elevations.drop_outliers(parsed(spark, sf)).select("sheet_id", "seq", "value_ft")


def sheet_scales(spark: SparkSession, sf: str) -> DataFrame:
    return scales.detect_scales(view(spark, sf, "spans"), view(spark, sf, "sheets"))


def scale_notes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "spans").withColumn("s", T.scale(F.col("text"))).where("s IS NOT NULL").select("sheet_id", "seq", "s.ft_per_inch", "s.confidence")


def symbol_hints(spark: SparkSession, sf: str) -> DataFrame:
    named = view(spark, sf, "spans").select("sheet_id", "seq", F.element_at(F.array(*[F.lit(x) for x in HINT_NAMES]), (F.col("seq") % len(HINT_NAMES) + 1).cast("int")).alias("name"))
    return named.select("sheet_id", "seq", "name", T.symbol_hint(F.col("name")).alias("symbol_hint"))


HINT_NAMES = ["EXISTING CONTOUR", "HEAVY DUTY CONCRETE", "PROPERTY LINE", "NEW BUILDING", "CONCRETE SIDEWALK", "TREE", "TOP OF CURB (TC)", "CURB CUT", "MATCH EXISTING"]


def associations(spark: SparkSession, sf: str) -> DataFrame:
    a = associate.associate(parsed(spark, sf), view(spark, sf, "points"), view(spark, sf, "kinds"))
    return a.select("sheet_id", "seq", "poly_seq", r6("distance"))


def association_rates(spark: SparkSession, sf: str) -> DataFrame:
    e = parsed(spark, sf)
    a = associate.associate(e, view(spark, sf, "points"), view(spark, sf, "kinds"), 20.0)
    return associate.association_rate(e, a).select("sheet_id", "callouts", "associated", r6("rate"))


def polyline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = polylines.metrics(view(spark, sf, "points"))
    return m.withColumn("shape", polylines.shape_class()).select("sheet_id", "poly_seq", "n_points", r6("length_px"), r6("straightness"), r6("mean_abs_turn"), "shape")


def coarse_styles(spark: SparkSession, sf: str) -> DataFrame:
    m = polylines.metrics(view(spark, sf, "points")).join(view(spark, sf, "kinds"), polylines.KEY)
    return m.groupBy(polylines.coarse_style(F.col("kind")).alias("style"), "kind").agg(F.count(F.lit(1)).alias("n"))


def stride_samples(spark: SparkSession, sf: str) -> DataFrame:
    return polylines.strided(view(spark, sf, "points"), 3).select("sheet_id", "poly_seq", "pos")


def redundant_polylines(spark: SparkSession, sf: str) -> DataFrame:
    return polylines.redundant(view(spark, sf, "points"))


def merged_levels(spark: SparkSession, sf: str) -> DataFrame:
    points = view(spark, sf, "points")
    levels = polylines.metrics(points).select(*polylines.KEY, "length_px").join(view(spark, sf, "kinds").select(*polylines.KEY, "z"), polylines.KEY)
    return polylines.merge_same_level(points, levels.withColumn("length_px", F.round("length_px", 6)))


def ranked_polylines(spark: SparkSession, sf: str) -> DataFrame:
    m = polylines.metrics(view(spark, sf, "points"))
    return polylines.top(m, F.round(polylines.curve_score(), 6), 20).select("sheet_id", "poly_seq", "rank")


def ink_signatures(spark: SparkSession, sf: str) -> DataFrame:
    p = styles.profiles(view(spark, sf, "ink").select("stroke_id", "pos", "gray"), ["stroke_id"])
    return p.select("stroke_id", "n", r6("ink_ratio"), r6("trans_rate"), r6("mean_gray"), "pattern")


def dashed_kinds(spark: SparkSession, sf: str) -> DataFrame:
    p = styles.profiles(view(spark, sf, "ink").select("stroke_id", "pos", "gray"), ["stroke_id"])
    return p.select("stroke_id", styles.dashed_kind(F.round(F.col("trans_rate") * (F.col("n") - 1)), F.col("ink_ratio"), F.col("n")).alias("kind"))


def stroke_styles(spark: SparkSession, sf: str) -> DataFrame:
    p = styles.profiles(view(spark, sf, "ink").select("stroke_id", "pos", "gray"), ["stroke_id"])
    p = p.withColumn("straightness", (F.col("stroke_id") % 100) / 100.0).withColumn("length_px", (F.col("stroke_id") % 300).cast("double")).withColumn("mean_abs_turn", (F.col("stroke_id") % 20) / 100.0)
    s = styles.styles(p, styles.templates(spark), ["stroke_id"])
    return s.select("stroke_id", "style", r6("score"), styles.styled_kind(F.col("style"), F.lit("topo"), F.lit("proposed")).alias("kind"))


def segment_filters(spark: SparkSession, sf: str) -> DataFrame:
    s = strokes.measured(view(spark, sf, "segments"))
    near = G.axis_distance(F.col("ang"))
    return s.select("sheet_id", "seq", r6("len"), r6("ang"), r6(near, "axis"), strokes.property_part().alias("property_part"), strokes.building_part().alias("building_part"))


def property_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Property lines chained from dashes and dots."""
    p = strokes.property_strokes(strokes.measured(view(spark, sf, "dashes")))
    return p.select("sheet_id", "chain", "members", r6("length"), r6("ang"))


def wall_lines(spark: SparkSession, sf: str) -> DataFrame:
    b = strokes.building_strokes(strokes.measured(view(spark, sf, "dashes")))
    return b.select("sheet_id", "chain", "members", r6("length"), r6("ang"))


def building_lines(spark: SparkSession, sf: str) -> DataFrame:
    b = strokes.building_strokes(strokes.measured(view(spark, sf, "segments")))
    return b.select("sheet_id", "chain", "members", r6("length"), r6("ang"))


def chain_score(spark: SparkSession, sf: str) -> DataFrame:
    s = strokes.measured(view(spark, sf, "segments")).withColumn("chain", F.col("seq") % 97)
    return strokes.property_scores(s).select("sheet_id", "chain", r6("score"))


def sheet_hulls(spark: SparkSession, sf: str) -> DataFrame:
    h = strokes.hulls(view(spark, sf, "samples").select("site_id", F.col("x_ft").alias("x"), F.col("y_ft").alias("y")), ["site_id"])
    return h.select("site_id", F.size("hull").alias("corners"))


def ring_distances(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    d = G.ring_distance(F.col("x"), F.col("y"), ring)
    return view(spark, sf, "spans").select("sheet_id", "seq", r6(d, "distance"), G.in_polygon(F.col("x"), F.col("y"), ring).alias("inside"))


def contour_layers(spark: SparkSession, sf: str) -> DataFrame:
    v = layers.layer_vertices(view(spark, sf, "points"), view(spark, sf, "kinds"))
    return v.groupBy("layer", "sheet_id").agg(F.count(F.lit(1)).alias("vertices"), F.count("x").alias("drawn"), F.sum("x").alias("sum_x"))


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "spans").select("sheet_id", "seq", T.anchor_tag(F.col("text")).alias("tag")).where("tag IS NOT NULL")


def clamped_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = F.struct((F.col("x1") - 20).alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1"))
    c = G.clamp_bbox(b, F.lit(900), F.lit(900))
    return view(spark, sf, "segments").select("sheet_id", "seq", *[c[k].alias(k) for k in ("x0", "y0", "x1", "y1")])


def rotated_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1"))
    c = G.rotated_bbox(b, [F.lit(float(v)) for v in (0, 1, -1, 0, 792, 0)], F.lit(2.0))
    return view(spark, sf, "segments").select("sheet_id", "seq", *[c[k].alias(k) for k in ("x0", "y0", "x1", "y1")])


def densified_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = strokes.densified(strokes.measured(view(spark, sf, "segments")).withColumnRenamed("len", "length"))
    return lines.select("sheet_id", "seq", F.size("points").alias("n"), r6(F.aggregate("points", F.lit(0.0), lambda t, p: t + p["x"]), "sum_x"), r6(F.element_at("points", -1)["y"], "last_y"))


def header_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = view(spark, sf, "spans").select("sheet_id", "seq", "text", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 40).alias("x1"), (F.col("y") + 10).alias("y1")).alias("bbox_px"))
    sheets = view(spark, sf, "sheets").withColumn("width_px", F.lit(1000))
    return layout.headers(spans, sheets).select("sheet_id", F.col("scale.x0").alias("x0"), F.col("scale.y0").alias("y0"))


def rail_splits(spark: SparkSession, sf: str) -> DataFrame:
    spans = view(spark, sf, "spans").select("sheet_id", F.struct(F.col("x").alias("x0"), (F.col("x") + 40).alias("x1")).alias("bbox_px"))
    return layout.fallback_split(spans, view(spark, sf, "sheets").withColumn("width_px", F.lit(1000))).select("sheet_id", F.col("fallback").cast("long").alias("fallback"))


def legend_rows(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "spans").select("sheet_id", "seq", T.legend_name(F.col("text")).alias("name")).where(T.is_legend_row(F.col("name")))


def room_windows(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "spans").select("sheet_id", T.anchor_tag(F.col("text")).alias("tag"), "x", "y")
    w = site.room_windows(a, F.lit(1000), F.lit(1000))
    return w.select("sheet_id", "rooms", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


def interior_shares(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    outlines = view(spark, sf, "sheets").select("sheet_id", ring.alias("property_polygon"), F.lit(None).cast("array<struct<x: double, y: double>>").alias("building_polygon"), F.struct(F.lit(300).alias("x0"), F.lit(300).alias("y0"), F.lit(500).alias("x1"), F.lit(450).alias("y1")).alias("building_bbox"))
    return site.inside_shares(view(spark, sf, "points"), outlines).select("sheet_id", "poly_seq", r6("share"))


def view_windows(spark: SparkSession, sf: str) -> DataFrame:
    box = lambda c, f: F.struct(*[g(F.col(v)).alias(f"{v[0]}{k}") for k, g in ((0, F.min), (1, F.max)) for v in ("x", "y")]).alias(c)
    plan = view(spark, sf, "spans").groupBy("sheet_id").agg(box("drawing_bbox", None), F.lit(1000.0).alias("width_px"), F.lit(900.0).alias("height_px"))
    found = view(spark, sf, "spans").where("text = 'TC' AND sheet_id LIKE '%2'").groupBy("sheet_id").agg(box("property_bbox", None))
    return layers.view_windows(plan, found)


def stage_statuses(spark: SparkSession, sf: str) -> DataFrame:
    n = view(spark, sf, "spans").groupBy("sheet_id").agg(F.count_if(F.col("text") == "TC").alias("n_elevations"), F.count_if(F.col("seq") % 50 == 0).alias("n_property"), F.count_if(F.col("seq") % 70 == 0).alias("n_associations"))
    s = n.join(view(spark, sf, "sheets"), "sheet_id").withColumn("scale_source", F.when(F.col("n_property") > 0, "pdf_span").otherwise("default"))
    s = s.withColumns({"n_legend": F.lit(0), "n_building": F.col("n_property"), "n_polylines": F.col("n_elevations"), "n_existing_samples": F.col("n_associations"), "computed": F.lit(True), "ok": F.col("n_property") > 0})
    return layers.stage_status(s).select("sheet_id", *[F.col("status")[k].alias(k) for k in ("scale", "legend", "elevations", "association", "cut_fill")], F.size("warnings").alias("warnings"))


RING = [(100.0, 100.0), (800.0, 150.0), (700.0, 900.0), (150.0, 700.0)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        site_volumes, nearest_volumes, volume_scores, score_texts, grid_extents, fused_samples, fused_volumes, elevation_context, elevation_readings, ocr_readings, elevations_clean, pad_levels,
        elevation_outliers, sheet_scales, scale_notes, symbol_hints, associations, association_rates, polyline_metrics, coarse_styles, stride_samples, redundant_polylines, merged_levels, ranked_polylines,
        ink_signatures, dashed_kinds, stroke_styles, segment_filters, property_lines, wall_lines, building_lines, chain_score, sheet_hulls, ring_distances, contour_layers, anchors,
        clamped_boxes, rotated_boxes, densified_lines, header_spans, rail_splits, legend_rows, room_windows, interior_shares, view_windows, stage_statuses,
    )
}

READ = r"""
ctx AS (SELECT a.sheet_id, a.seq, a.text, a.x, a.y, s.role, string_agg(b.text, ' ' ORDER BY b.seq) AS context
  FROM fx_spans a JOIN fx_sheets s USING (sheet_id) JOIN fx_spans b ON a.sheet_id = b.sheet_id AND abs(a.x - b.x) <= 70 AND abs(a.y - b.y) <= 70
  WHERE regexp_matches(a.text, '^(EL(EV)?\.?\s*)?[+-]?\d{3,4}(\.\d{1,3})?$', 'i') GROUP BY ALL),
num AS (SELECT *, CAST(regexp_extract(text, '([+-]?\d{3,4}(\.\d{1,3})?)$', 1) AS DOUBLE) AS v, contains(text, '.') AND regexp_matches(text, '\d\.\d{1,3}$') AS is_decimal,
  regexp_matches(context, '\b(TC|ME|EL|ELEV|ELEVATION|TOP\s*OF\s*CURB|SPOT|GRADE|FF|FFE)\b', 'i') AS speaks, regexp_matches(context, '\bME\b', 'i') AS me FROM ctx),
parsed AS (SELECT sheet_id, seq, x, y, role, v AS value_ft,
  CASE WHEN role = 'existing' OR (is_decimal AND me) THEN 'existing_match' WHEN is_decimal THEN 'spot' ELSE 'weak' END AS kind,
  CASE WHEN is_decimal THEN CASE WHEN speaks THEN 0.95 ELSE 0.8 END WHEN speaks THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence
  FROM num WHERE v BETWEEN 800 AND 1200 AND (is_decimal OR role = 'existing'))"""
READINGS = with_views("spans", "sheets") + "," + READ
LINES = r"""
usable AS (SELECT * FROM (SELECT *, bool_or(kind IN ('topo', 'existing', 'proposed')) OVER w AS topo, bool_or(kind = 'existing') OVER w AS has_existing, bool_or(kind = 'proposed') OVER w AS has_proposed
  FROM fx_kinds WINDOW w AS (PARTITION BY sheet_id)) WHERE NOT topo OR kind IN ('topo', 'existing', 'proposed')),
steps AS (SELECT sheet_id, poly_seq, pos, x AS x1, y AS y1, coalesce(x2, x) AS x2, coalesce(y2, y) AS y2 FROM
  (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fx_points WINDOW w AS (PARTITION BY sheet_id, poly_seq ORDER BY pos)) WHERE x2 IS NOT NULL OR pos = 0),
met AS (SELECT e.sheet_id, e.seq, s.poly_seq, s.pos, e.x, e.y, x1, y1, x2, y2, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS size FROM parsed e JOIN usable u USING (sheet_id) JOIN steps s USING (sheet_id, poly_seq)
  WHERE CASE WHEN e.kind = 'existing_match' AND has_existing THEN u.kind = 'existing' WHEN e.kind IN ('spot', 'ffe') AND has_proposed THEN u.kind = 'proposed' ELSE true END),
foot AS (SELECT *, CASE WHEN size < 1e-9 THEN 0.0 ELSE greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / size)) END AS t FROM met),
near AS (SELECT *, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS distance FROM foot),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY sheet_id, seq ORDER BY round(distance, 9), poly_seq, pos) = 1)"""
METRICS = r"""
stp AS (SELECT sheet_id, poly_seq, pos, x, y, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM fx_points WINDOW w AS (PARTITION BY sheet_id, poly_seq ORDER BY pos)),
trn AS (SELECT *, atan2(dy, dx) - atan2(lag(dy) OVER w, lag(dx) OVER w) + pi() AS raw FROM stp WINDOW w AS (PARTITION BY sheet_id, poly_seq ORDER BY pos)),
agg AS (SELECT sheet_id, poly_seq, count(*) AS n_points, coalesce(sum(sqrt(dx * dx + dy * dy)), 0.0) AS length_px, arg_max(x, pos) - arg_min(x, pos) AS dx, arg_max(y, pos) - arg_min(y, pos) AS dy,
  coalesce(avg(abs(raw - 2 * pi() * floor(raw / (2 * pi())) - pi())), 0.0) AS mean_abs_turn FROM trn GROUP BY ALL),
met AS (SELECT *, CASE WHEN n_points < 2 THEN 1.0 ELSE sqrt(dx * dx + dy * dy) / greatest(length_px, 1e-3) END AS straightness, abs(degrees(atan2(dy, dx))) % 180 AS angle FROM agg)"""
SHARES = r"""
siz AS (SELECT *, count(*) OVER (PARTITION BY sheet_id, poly_seq) AS n FROM fx_points),
smp AS (SELECT *, count(*) OVER (PARTITION BY sheet_id, poly_seq) AS samples FROM siz WHERE n >= 2 AND pos % greatest(1, n // 20) = 0),
shares AS (SELECT a.sheet_id, a.poly_seq, b.poly_seq AS other_seq, count(DISTINCT a.pos) / any_value(a.samples) AS share
  FROM smp a JOIN siz b ON a.sheet_id = b.sheet_id AND a.poly_seq <> b.poly_seq AND b.n >= 2 AND abs(a.x - b.x) < 10 AND abs(a.y - b.y) < 10 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 100
  GROUP BY ALL)"""
PROFILE = r"""
chg AS (SELECT *, CASE WHEN ink = lag(ink) OVER w THEN 0 ELSE 1 END AS c FROM fx_ink WINDOW w AS (PARTITION BY stroke_id ORDER BY pos)),
rid AS (SELECT *, sum(c) OVER (PARTITION BY stroke_id ORDER BY pos) AS run FROM chg),
runs AS (SELECT stroke_id, run, ink, count(*) AS size FROM rid GROUP BY ALL),
med AS (SELECT stroke_id, count(*) - 1 AS transitions, count(*) FILTER (WHERE ink AND size >= 2) AS inks, count(*) FILTER (WHERE NOT ink AND size >= 2) AS gaps, median(size) FILTER (WHERE ink AND size >= 2) AS m FROM runs GROUP BY ALL),
rel AS (SELECT stroke_id, count(*) FILTER (WHERE size / m >= 1.6) AS longs, count(*) FILTER (WHERE size / m <= 0.75) AS shorts FROM runs JOIN med USING (stroke_id) WHERE ink AND size >= 2 GROUP BY ALL),
bas AS (SELECT stroke_id, count(*) AS n, avg(ink::INT) AS ink_ratio, coalesce(avg(gray) FILTER (WHERE ink), avg(gray)) AS mean_gray FROM fx_ink GROUP BY ALL),
prof AS (SELECT stroke_id, n, ink_ratio, transitions, transitions / greatest(n - 1, 1) AS trans_rate, mean_gray,
  CASE WHEN inks <= 1 OR (inks = 2 AND gaps <= 2) THEN 'solid' WHEN longs >= 1 AND shorts >= 2 AND inks >= 3 THEN 'dash_dot_dot' ELSE 'dashed' END AS pattern FROM bas JOIN med USING (stroke_id) LEFT JOIN rel USING (stroke_id))"""


def extent_sql(table: str, n: int, pad: float) -> str:
    return f"""
ext0 AS (SELECT site_id, min(x_ft) AS lx, max(x_ft) AS hx, min(y_ft) AS ly, max(y_ft) AS hy, {pad} * greatest(max(x_ft) - min(x_ft), max(y_ft) - min(y_ft), 1.0) AS pad FROM {table} GROUP BY ALL),
ext AS (SELECT site_id, lx - pad AS x0, ly - pad AS y0, (hx - lx + 2 * pad) / {n - 1} AS dx, (hy - ly + 2 * pad) / {n - 1} AS dy FROM ext0)"""


def paired_sql(table: str, within: str = "true", frames: str = "") -> str:
    return f"""
n AS (SELECT site_id, count(*) FILTER (WHERE surface = 'existing') AS ne, count(*) FILTER (WHERE surface = 'proposed') AS np FROM {table} GROUP BY ALL),
grid AS (SELECT c.site_id, c.cell, CASE WHEN np >= 3 THEN z.proposed END AS p, CASE WHEN np >= 3 THEN CASE WHEN ne < 3 THEN z.proposed - 0.25 ELSE coalesce(z.existing, z.proposed - 0.15) END END AS e
  FROM cells c JOIN n USING (site_id) {frames} LEFT JOIN z ON z.site_id = c.site_id AND z.i = c.i AND z.j = c.j AND {within}),
vol AS (SELECT site_id, coalesce(sum(e - p) FILTER (WHERE p < e), 0.0) * max(cell * cell) / 27 AS cut, coalesce(sum(p - e) FILTER (WHERE p > e), 0.0) * max(cell * cell) / 27 AS fill, count(p - e) AS cell_count FROM grid GROUP BY ALL)"""


def nodes_sql(table: str, n: int) -> str:
    return f"""
cells AS (SELECT site_id, i, j, x0 + j * dx AS x, y0 + i * dy AS y, greatest(dx, dy) AS cell FROM ext, range({n}) r(i), range({n}) q(j)),
pts AS (SELECT site_id, surface, x_ft AS px, y_ft AS py, min(seq) AS seq, arg_min(z, seq) AS z, row_number() OVER (PARTITION BY site_id, surface ORDER BY min(seq), x_ft, y_ft) AS id FROM {table} GROUP BY site_id, surface, x_ft, y_ft),
nst AS (SELECT site_id, surface, i, j, arg_min(z, struct_pack(d := (x - px) * (x - px) + (y - py) * (y - py), s := seq)) AS z FROM cells JOIN pts USING (site_id) GROUP BY ALL)"""


EXTENT, PAIRED, NODES = extent_sql("fx_samples", GRID, 0.05), paired_sql("fx_samples"), nodes_sql("fx_samples", GRID)
# Triangles without a point in their circle, by brute force: exact for sites of some dozen points.
TIN = f"""
tri AS (SELECT a.site_id, a.surface, a.id AS sa, b.id AS sb, c.id AS sc, a.px AS xa, a.py AS ya, a.z AS za, b.px AS xb, b.py AS yb, b.z AS zb, c.px AS xc, c.py AS yc, c.z AS zc,
  2 * ((b.px - a.px) * (c.py - a.py) - (b.py - a.py) * (c.px - a.px)) AS d FROM pts a JOIN pts b ON a.site_id = b.site_id AND a.surface = b.surface AND a.id < b.id JOIN pts c ON a.site_id = c.site_id AND a.surface = c.surface AND b.id < c.id),
cir AS (SELECT *, ((yc - ya) * (pow(xb - xa, 2) + pow(yb - ya, 2)) - (yb - ya) * (pow(xc - xa, 2) + pow(yc - ya, 2))) / d AS ux, ((xb - xa) * (pow(xc - xa, 2) + pow(yc - ya, 2)) - (xc - xa) * (pow(xb - xa, 2) + pow(yb - ya, 2))) / d AS uy FROM tri WHERE d <> 0),
del AS (SELECT * FROM cir t WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.site_id = t.site_id AND p.surface = t.surface AND p.id NOT IN (t.sa, t.sb, t.sc)
  AND pow(p.px - t.xa - t.ux, 2) + pow(p.py - t.ya - t.uy, 2) < (t.ux * t.ux + t.uy * t.uy) * (1 - 1e-12))),
hit AS (SELECT t.*, c.i, c.j, ((yb - yc) * (x - xc) + (xc - xb) * (y - yc)) / ((yb - yc) * (xa - xc) + (xc - xb) * (ya - yc)) AS u, ((yc - ya) * (x - xc) + (xa - xc) * (y - yc)) / ((yb - yc) * (xa - xc) + (xc - xb) * (ya - yc)) AS v
  FROM del t JOIN cells c ON t.site_id = c.site_id AND x BETWEEN least(xa, xb, xc) - 1e-6 AND greatest(xa, xb, xc) + 1e-6 AND y BETWEEN least(ya, yb, yc) - 1e-6 AND greatest(ya, yb, yc) + 1e-6),
lin AS (SELECT site_id, surface, i, j, min(u * za + v * zb + (1 - u - v) * zc) AS z FROM hit WHERE u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9 GROUP BY ALL),
itp AS (SELECT nst.site_id, nst.surface, nst.i, nst.j, coalesce(lin.z, nst.z) AS z FROM nst LEFT JOIN lin USING (site_id, surface, i, j))"""
WIDE = "z AS (SELECT site_id, i, j, max(z) FILTER (WHERE surface = 'existing') AS existing, max(z) FILTER (WHERE surface = 'proposed') AS proposed FROM {} GROUP BY ALL)"
DONE = "CASE WHEN cell_count > 0 THEN 'Deterministic grid cut/fill (proposed - existing).' ELSE 'No surface grid available for cut/fill.' END AS message"
HINTS = "\n".join("  WHEN " + " AND ".join(f"contains(name, '{w}')" for w in words) + f" THEN '{hint}'" for words, hint in T.SYMBOL_HINTS)
EDGES = ", ".join(f"({x}, {y}, {u}, {v})" for (x, y), (u, v) in zip(RING, RING[1:] + RING[:1], strict=True))
FUSED = """
f AS (SELECT *, greatest(pw * 0.55, 40.0) AS half_w, greatest(ph * 0.55, 40.0) AS half_h,
  greatest(0.55, least(1.8, CASE WHEN ew > 1 AND pw > 1 AND eh > 1 AND ph > 1 THEN (pw / ew + ph / eh) / 2 WHEN ew > 1 AND pw > 1 THEN pw / ew WHEN eh > 1 AND ph > 1 THEN ph / eh ELSE 1.0 END)) AS s FROM fx_frames),
raw AS (SELECT site_id, surface, seq, x_ft - 500 AS x_ft, y_ft - 500 AS y_ft, z FROM fx_samples),
ex AS (SELECT site_id, surface, seq, x_ft * k AS x_ft, y_ft * k AS y_ft, z, half_w, half_h FROM raw JOIN f USING (site_id), unnest([s, 1.0]) t(k) WHERE surface = 'existing'),
pr AS (SELECT raw.*, abs(x_ft) <= half_w * 1.15 AND abs(y_ft) <= half_h * 1.15 AS inside FROM raw JOIN f USING (site_id) WHERE surface = 'proposed'),
fused AS (SELECT site_id, surface, seq, x_ft, y_ft, z FROM ex WHERE abs(x_ft) <= half_w * 1.25 AND abs(y_ft) <= half_h * 1.25
  UNION ALL SELECT site_id, surface, seq, x_ft, y_ft, z FROM pr WHERE inside OR (SELECT count(*) FROM pr q WHERE q.site_id = pr.site_id AND q.inside) < 3)"""

# Sites of fewer than three proposed samples take all their samples as proposed.
FALLBACK = """
few AS (SELECT site_id FROM fx_samples GROUP BY ALL HAVING count(*) FILTER (WHERE surface = 'proposed') < 3),
fb AS (SELECT site_id, surface, seq, x_ft, y_ft, z FROM fx_samples WHERE surface = 'existing' OR site_id NOT IN (SELECT site_id FROM few) UNION ALL SELECT site_id, 'proposed', seq, x_ft, y_ft, z FROM fx_samples WHERE site_id IN (SELECT site_id FROM few))"""
ELLIPSE = "pow(c.x / half_w, 2) + pow(c.y / half_h, 2) <= 1.05"
# Lines of twelve pieces as the dashes view draws them: what chaining has to find again.
DRAWN = """
g AS (SELECT sheet_id, seq, w, CAST(floor((row_number() OVER (PARTITION BY sheet_id ORDER BY seq) - 1) / 12) AS BIGINT) AS line, row_number() OVER (PARTITION BY sheet_id, w > 1.4 ORDER BY seq) - 1 AS nr, x1, y1, x2, y2 FROM fx_dashes),
l AS (SELECT sheet_id, min(nr) AS chain, count(*) AS members, CAST(max(x2) - min(x1) + max(y2) - min(y1) AS DOUBLE) AS length, CASE WHEN max(y2) > min(y1) THEN 90.0 ELSE 0.0 END::DOUBLE AS ang, any_value(w) > 1.4 AS wall FROM g GROUP BY sheet_id, line),
k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, wall ORDER BY length DESC, chain) AS rank FROM l)"""

SQL = {
    "fused_volumes": f"{with_views('samples', 'frames')},{FUSED},{extent_sql('fused', FUSED_GRID, 0.04)},{nodes_sql('fused', FUSED_GRID)},{TIN},{WIDE.format('itp')},{paired_sql('fused', ELLIPSE, 'JOIN f USING (site_id)')} SELECT site_id, round(cut, 3) AS cut_cy, round(fill, 3) AS fill_cy, cell_count > 0 AS ok, cell_count FROM vol",
    # All property lines lie within their hull, so the 28 longest stay.
    "property_lines": f"{with_views('dashes')},{DRAWN} SELECT sheet_id, chain, members, length, ang FROM k WHERE NOT wall AND rank <= 28",
    "wall_lines": f"{with_views('dashes')},{DRAWN} SELECT sheet_id, chain, members, length, ang FROM k WHERE wall AND rank <= 50",
    "site_volumes": f"{with_views('samples')},{FALLBACK},{extent_sql('fb', GRID, 0.05)},{nodes_sql('fb', GRID)},{TIN},{WIDE.format('itp')},{paired_sql('fb')} SELECT site_id, round(cut, 3) AS cut_cy, round(fill, 3) AS fill_cy, round(fill - cut, 3) AS net_cy, cell_count > 0 AS ok, {DONE}, cell_count FROM vol",
    "nearest_volumes": f"{with_views('samples')},{EXTENT},{NODES},{WIDE.format('nst')},{PAIRED} SELECT site_id, round(cut, 3) AS cut_cy, round(fill, 3) AS fill_cy, cell_count > 0 AS ok, cell_count FROM vol",
    "volume_scores": f"""{with_views('samples', 'truth')}, p AS (SELECT site_id, sum(z) FILTER (WHERE surface = 'existing') AS cut, sum(z) FILTER (WHERE surface = 'proposed') AS fill FROM fx_samples GROUP BY ALL),
e AS (SELECT site_id, abs(cut - cut_cy) AS c, abs(fill - fill_cy) AS g, cut_cy, fill_cy, abs((fill - cut) - (fill_cy - cut_cy)) AS n FROM p LEFT JOIN fx_truth USING (site_id)),
q AS (SELECT *, CASE WHEN cut_cy <> 0 THEN c / cut_cy * 100 END AS cp, CASE WHEN fill_cy <> 0 THEN g / fill_cy * 100 END AS gp FROM e)
SELECT site_id, round(c, 6) AS cut_abs_error, round(g, 6) AS fill_abs_error, round(cp, 6) AS cut_pct_error, round(gp, 6) AS fill_pct_error, round(n, 6) AS net_abs_error,
  (cp IS NOT NULL OR gp IS NOT NULL) AND coalesce(cp, 0) <= 5 AND coalesce(gp, 0) <= 5 AS within_tolerance FROM q""",
    "score_texts": f"""{with_views('samples')}, p AS (SELECT site_id, count(*) FILTER (WHERE surface = 'existing') AS c, count(*) FILTER (WHERE surface = 'proposed') AS f FROM fx_samples GROUP BY ALL)
SELECT site_id, format('{{:,}} CY', c) AS cut, format('{{:,}} CY', f) AS fill, CASE WHEN c = 0 THEN '—' ELSE '50.0%' END AS cut_error, '—' AS fill_error FROM p""",
    "grid_extents": f"{with_views('samples')},{EXTENT} SELECT site_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(dx, 6) AS dx, round(dy, 6) AS dy, round(greatest(dx, dy), 6) AS cell_ft FROM ext",
    "fused_samples": f"{with_views('samples', 'frames')},{FUSED} SELECT site_id, surface, seq, round(x_ft, 6) AS x_ft, round(y_ft, 6) AS y_ft, z FROM fused",
    "elevation_context": f"{with_views('spans')} SELECT a.sheet_id, a.seq, string_agg(b.text, ' ' ORDER BY b.seq) AS context FROM fx_spans a JOIN fx_spans b ON a.sheet_id = b.sheet_id AND abs(a.x - b.x) <= 70 AND abs(a.y - b.y) <= 70 WHERE starts_with(a.text, 'EL') GROUP BY ALL",
    "elevation_readings": f"{READINGS} SELECT sheet_id, seq, value_ft, confidence, kind FROM parsed",
    "ocr_readings": rf"""{with_views('spans', 'sheets')}, t AS (SELECT *, CAST(regexp_extract(text, '([+-]?\d{{3,4}}(\.\d{{1,3}})?)$', 1) AS DOUBLE) AS v, contains(text, '.') AND regexp_matches(text, '\d\.\d{{1,3}}$') AS dec, regexp_matches(text, '\bEL\b') AS speaks
  FROM fx_spans JOIN fx_sheets USING (sheet_id) WHERE regexp_matches(text, '^(EL\.?\s*)?[+-]?\d{{3,4}}(\.\d{{1,3}})?$'))
SELECT sheet_id, seq, v AS value_ft, round(least((seq % 10) / 10.0, CASE WHEN dec THEN CASE WHEN speaks THEN 0.95 ELSE 0.8 END WHEN speaks THEN 0.7 ELSE 0.6 END), 6)::DOUBLE AS confidence, CASE WHEN role = 'existing' THEN 'existing_match' WHEN dec THEN 'spot' ELSE 'weak' END AS kind
FROM t WHERE v BETWEEN 800 AND 1200 AND (dec OR role = 'existing' OR speaks)""",
    "pad_levels": f"""{READINGS}, lev AS (SELECT * REPLACE (floor(value_ft / 20) * 20.0 AS value_ft) FROM parsed),
cen AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM lev WINDOW w AS (PARTITION BY sheet_id, value_ft)),
rnk AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, value_ft ORDER BY pow(x - cx, 2) + pow(y - cy, 2), seq) AS k FROM cen)
SELECT sheet_id, seq, value_ft, CASE WHEN n >= 5 THEN least(confidence, 0.7) ELSE confidence END::DOUBLE AS confidence, CASE WHEN n >= 5 THEN 'ffe' ELSE kind END AS kind FROM rnk WHERE n < 5 OR k = 1""",
    "elevation_outliers": f"{READINGS} SELECT sheet_id, seq, value_ft FROM (SELECT *, count(*) OVER (PARTITION BY sheet_id) AS n, median(value_ft) OVER (PARTITION BY sheet_id) AS m FROM parsed) WHERE n < 5 OR abs(value_ft - m) <= 25",
    "sheet_scales": rf"""{with_views('spans', 'sheets')}, f AS (SELECT *, CAST(regexp_extract(text, '= (\d+) ft$', 1) AS DOUBLE) AS v FROM fx_spans WHERE starts_with(text, 'SCALE')), b AS (SELECT sheet_id, arg_min(v, seq) AS v FROM f WHERE v BETWEEN 1 AND 200 GROUP BY ALL)
SELECT sheet_id, coalesce(v, 10.0)::DOUBLE AS ft_per_inch, CASE WHEN v IS NULL THEN 'default' ELSE 'pdf_span' END AS source, CASE WHEN v IS NULL THEN 0.2 ELSE 0.95 END::DOUBLE AS confidence FROM fx_sheets LEFT JOIN b USING (sheet_id)""",
    "scale_notes": rf"{with_views('spans')} SELECT sheet_id, seq, CAST(regexp_extract(text, '= (\d+) ft$', 1) AS DOUBLE) AS ft_per_inch, 0.95::DOUBLE AS confidence FROM fx_spans WHERE starts_with(text, 'SCALE')",
    "symbol_hints": f"{with_views('spans')}, n AS (SELECT sheet_id, seq, {HINT_NAMES!r}[seq % {len(HINT_NAMES)} + 1] AS name FROM fx_spans) SELECT *, CASE {HINTS} ELSE '{T.OTHER_SYMBOL}' END AS symbol_hint FROM n",
    "associations": f"{with_views('spans', 'sheets', 'points', 'kinds')},{READ},{LINES} SELECT sheet_id, seq, poly_seq, round(distance, 6) AS distance FROM best WHERE distance <= 48",
    "association_rates": f"{with_views('spans', 'sheets', 'points', 'kinds')},{READ},{LINES}, a AS (SELECT sheet_id, count(*) AS m FROM best WHERE distance <= 20 GROUP BY ALL), c AS (SELECT sheet_id, count(*) AS callouts FROM parsed GROUP BY ALL) SELECT sheet_id, callouts, coalesce(m, 0) AS associated, round(coalesce(m, 0) / callouts, 6) AS rate FROM c LEFT JOIN a USING (sheet_id)",
    "polyline_metrics": f"""{with_views('points')},{METRICS} SELECT sheet_id, poly_seq, n_points, round(length_px, 6) AS length_px, round(straightness, 6) AS straightness, round(mean_abs_turn, 6) AS mean_abs_turn,
  CASE WHEN n_points < 2 THEN 'structure' WHEN mean_abs_turn >= 0.10 THEN 'topo' WHEN straightness > 0.93 AND least(angle, abs(90 - angle), abs(180 - angle)) < 10 AND length_px > 90 THEN 'structure' WHEN straightness > 0.985 AND length_px > 140 THEN 'structure' ELSE 'topo' END AS shape FROM met""",
    "coarse_styles": f"""{with_views('points', 'kinds')},{METRICS} SELECT CASE WHEN mean_abs_turn >= 0.12 OR NOT (straightness > 0.92 AND length_px > 120) THEN 'topo_curve' WHEN kind = 'existing' THEN 'contour_dash' WHEN kind = 'property' THEN 'property_dashdot'
  WHEN kind IN ('building', 'structure') OR straightness > 0.98 THEN 'building_solid' ELSE 'property_dashdot' END AS style, kind, count(*) AS n FROM met JOIN fx_kinds USING (sheet_id, poly_seq) GROUP BY ALL""",
    "stride_samples": f"{with_views('points')} SELECT sheet_id, poly_seq, pos FROM (SELECT *, count(*) OVER (PARTITION BY sheet_id, poly_seq) AS n FROM fx_points) WHERE pos % greatest(1, n // 3) = 0",
    "redundant_polylines": f"{with_views('points')},{SHARES} SELECT DISTINCT sheet_id, poly_seq FROM shares WHERE share >= 0.45",
    "merged_levels": f"""{with_views('points', 'kinds')},{METRICS},{SHARES}, lv AS (SELECT sheet_id, poly_seq, z, first_value(poly_seq) OVER (PARTITION BY sheet_id, z ORDER BY round(length_px, 6) DESC, poly_seq) AS prim FROM met JOIN fx_kinds USING (sheet_id, poly_seq))
SELECT sheet_id, poly_seq FROM lv WHERE NOT EXISTS (SELECT 1 FROM shares s WHERE lv.z IS NOT NULL AND lv.poly_seq <> lv.prim AND s.sheet_id = lv.sheet_id AND s.poly_seq = lv.poly_seq AND s.other_seq = lv.prim AND share >= 0.45)""",
    "ranked_polylines": f"{with_views('points')},{METRICS} SELECT sheet_id, poly_seq, row_number() OVER (PARTITION BY sheet_id ORDER BY round(length_px * (1 + 2 * mean_abs_turn), 6) DESC, poly_seq) AS rank FROM met QUALIFY rank <= 20",
    "ink_signatures": f"{with_views('ink')},{PROFILE} SELECT stroke_id, n, round(ink_ratio, 6) AS ink_ratio, round(trans_rate, 6) AS trans_rate, round(mean_gray, 6) AS mean_gray, pattern FROM prof",
    "dashed_kinds": f"{with_views('ink')},{PROFILE} SELECT stroke_id, CASE WHEN n >= 6 AND transitions >= 5 AND ink_ratio > 0.2 AND ink_ratio < 0.88 THEN 'existing' ELSE 'proposed' END AS kind FROM prof",
    "stroke_styles": f"""{with_views('ink')},{PROFILE}, s AS (SELECT *, (stroke_id % 100) / 100.0 AS straight, stroke_id % 300 AS len, (stroke_id % 20) / 100.0 AS turn FROM prof),
t(place, name, sig, il, ih, tl, th, g) AS (VALUES {', '.join(str((i, *t)) for i, t in enumerate(styles.TEMPLATES))}),
sc AS (SELECT stroke_id, place, name, round(CASE WHEN ink_ratio BETWEEN il AND ih THEN 1.5 ELSE -3 * greatest(il - ink_ratio, ink_ratio - ih) END + CASE WHEN trans_rate BETWEEN tl AND th THEN 1.5 ELSE -4 * greatest(tl - trans_rate, trans_rate - th) END
  + CASE WHEN mean_gray <= g THEN 0.5 ELSE -0.5 END + CASE WHEN sig = pattern THEN CASE WHEN sig = 'dash_dot_dot' THEN 2.0 ELSE 1.2 END WHEN sig = 'dash_dot_dot' AND pattern = 'dashed' THEN 0.3 ELSE 0 END
  + CASE WHEN name = 'property_line' THEN CASE WHEN straight > 0.92 AND len > 80 THEN 0.8 ELSE 0 END - CASE WHEN turn > 0.14 THEN 1 ELSE 0 END ELSE CASE WHEN turn >= 0.06 OR straight < 0.98 THEN 0.4 ELSE 0 END END, 9)::DOUBLE AS score FROM s, t),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY stroke_id ORDER BY score DESC, place) = 1),
k AS (SELECT stroke_id, CASE WHEN score < 1.2 THEN 'other' ELSE name END AS style, score FROM b)
SELECT stroke_id, style, round(score, 6) AS score, CASE style WHEN 'property_line' THEN NULL WHEN 'existing_contour' THEN 'existing' ELSE 'proposed' END AS kind FROM k""",
    "segment_filters": f"""{with_views('segments')}, s AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len, degrees(atan2(y2 - y1, x2 - x1)) AS a0 FROM fx_segments), a AS (SELECT *, a0 - 180 * floor(a0 / 180) AS ang FROM s)
SELECT sheet_id, seq, round(len, 6) AS len, round(ang, 6) AS ang, round(least(ang, 180 - ang, abs(ang - 90)), 6) AS axis, color0 <= 0.15 AND w <= 1.4 AND len <= 90 AS property_part, color0 <= 0.2 AND w >= 1.2 AND len >= 10 AS building_part FROM a""",
    "chain_score": f"""{with_views('segments')}, s AS (SELECT sheet_id, seq % 97 AS chain, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM fx_segments),
m AS (SELECT sheet_id, chain, count(*) AS n, median(len) AS med, stddev_pop(len) / greatest(avg(len), 1e-3) AS cv FROM s GROUP BY ALL),
r AS (SELECT sheet_id, chain, any_value(n) AS n, any_value(med) AS med, any_value(cv) AS cv, count(*) FILTER (WHERE len <= med * 1.3) AS s1, count(*) FILTER (WHERE len >= greatest(med * 2, med + 4)) AS l1, median(len) FILTER (WHERE len <= med * 1.3) AS ms1, median(len) FILTER (WHERE len >= greatest(med * 2, med + 4)) AS ml1,
  count(*) FILTER (WHERE len <= 12) AS s2, count(*) FILTER (WHERE len >= 18) AS l2, median(len) FILTER (WHERE len <= 12) AS ms2, median(len) FILTER (WHERE len >= 18) AS ml2 FROM s JOIN m USING (sheet_id, chain) GROUP BY ALL),
q AS (SELECT *, l1 < 1 OR s1 < 2 AS few FROM r), v AS (SELECT *, CASE WHEN few THEN l2 < 1 OR s2 < 2 ELSE false END AS short_of, CASE WHEN few THEN ml2 / greatest(ms2, 0.1) ELSE ml1 / greatest(ms1, 0.1) END AS ratio FROM q)
SELECT sheet_id, chain, round(CASE WHEN n < 3 OR med <= 0 THEN 0 WHEN short_of THEN CASE WHEN n >= 6 AND cv > 0.15 THEN 2 + least(1.0, n / 20) ELSE 0 END WHEN ratio BETWEEN 2 AND 10 THEN 2 + CASE WHEN n >= 4 THEN 0.8 ELSE 0 END + CASE WHEN cv >= 0.25 THEN 0.5 ELSE 0 END ELSE 0 END, 6)::DOUBLE AS score FROM v""",
    "sheet_hulls": f"""{with_views('samples')}, p AS (SELECT DISTINCT site_id, x_ft AS x, y_ft AS y FROM fx_samples),
e AS (SELECT a.site_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON a.site_id = b.site_id AND (a.x <> b.x OR a.y <> b.y)),
h AS (SELECT site_id, ax, ay FROM e WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.site_id = e.site_id AND ((bx - ax) * (c.y - ay) - (b_y - ay) * (c.x - ax) < 0
  OR ((bx - ax) * (c.y - ay) - (b_y - ay) * (c.x - ax) = 0 AND pow(c.x - ax, 2) + pow(c.y - ay, 2) > pow(bx - ax, 2) + pow(b_y - ay, 2)
  OR ((bx - ax) * (c.y - ay) - (b_y - ay) * (c.x - ax) = 0 AND (bx - ax) * (c.x - ax) + (b_y - ay) * (c.y - ay) < 0)))))
SELECT p.site_id, CAST(CASE WHEN count(DISTINCT (p.x, p.y)) = 1 THEN 1 ELSE count(DISTINCT (ax, ay)) END AS INT) AS corners FROM p LEFT JOIN h USING (site_id) GROUP BY ALL""",
    "ring_distances": f"""{with_views('spans')}, e(x1, y1, x2, y2) AS (VALUES {EDGES}), d AS (SELECT sheet_id, seq, x, y, x1, y1, x2, y2, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM fx_spans, e),
g AS (SELECT sheet_id, seq, min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))) AS d, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM d GROUP BY ALL)
SELECT sheet_id, seq, round(CASE WHEN inside THEN d ELSE -d END, 6) AS distance, inside FROM g""",
    "contour_layers": f"""{with_views('points', 'kinds')}, p AS (SELECT CASE WHEN kind = 'existing' THEN 'existing' ELSE 'proposed' END AS layer, sheet_id, poly_seq, x, count(*) OVER (PARTITION BY sheet_id, poly_seq) AS n FROM fx_points JOIN fx_kinds USING (sheet_id, poly_seq) WHERE kind NOT IN ('structure', 'property', 'building'))
SELECT layer, sheet_id, count(*) + count(DISTINCT poly_seq) AS vertices, count(*) AS drawn, sum(x) AS sum_x FROM p WHERE n > 1 GROUP BY ALL""",
    "anchors": rf"{with_views('spans')}, t AS (SELECT sheet_id, seq, CASE WHEN regexp_full_match(text, '\d{{3}}') THEN 'room' WHEN contains(upper(text), 'BUILDING LINE') THEN 'bl' WHEN regexp_matches(upper(text), 'SIDEWALK|CURB|LANDSCAPE BUFFER') THEN 'edge' WHEN regexp_matches(text, '\d\+\d{{2}}') THEN 'sta' WHEN regexp_matches(upper(text), '{'|'.join(T.ROOM_WORDS)}') THEN 'room_label' END AS tag FROM fx_spans) SELECT * FROM t WHERE tag IS NOT NULL",
    "clamped_boxes": f"""{with_views('segments')}, c AS (SELECT sheet_id, seq, CAST(greatest(0, least(900, trunc(x1 - 20))) AS INT) AS a, CAST(greatest(0, least(900, trunc(x2))) AS INT) AS b, CAST(greatest(0, least(900, trunc(y1))) AS INT) AS c, CAST(greatest(0, least(900, trunc(y2))) AS INT) AS d FROM fx_segments)
SELECT sheet_id, seq, least(a, b) AS x0, least(c, d) AS y0, CASE WHEN a = b THEN least(a + 1, 900) ELSE greatest(a, b) END AS x1, CASE WHEN c = d THEN least(c + 1, 900) ELSE greatest(c, d) END AS y1 FROM c""",
    "rotated_boxes": f"{with_views('segments')} SELECT sheet_id, seq, (792 - greatest(y1, y2)) * 2 AS x0, least(x1, x2) * 2 AS y0, (792 - least(y1, y2)) * 2 AS x1, greatest(x1, x2) * 2 AS y1 FROM fx_segments",
    "densified_lines": f"{with_views('segments')}, s AS (SELECT *, CAST(greatest(8, floor(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 10)) AS INT) AS n FROM fx_segments) SELECT sheet_id, seq, n, round(n * (x1 + x2) / 2, 6) AS sum_x, round(y2, 6) AS last_y FROM s",
    "header_spans": f"{with_views('spans', 'sheets')}, h AS (SELECT * FROM fx_spans WHERE contains(upper(text), 'SCALE') OR contains(text, '1\"') QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY x <= 500, y, seq) = 1) SELECT sheet_id, x AS x0, y AS y0 FROM fx_sheets LEFT JOIN h USING (sheet_id) WHERE sheet_id IN (SELECT sheet_id FROM fx_spans)",
    "rail_splits": f"{with_views('spans', 'sheets')}, r AS (SELECT sheet_id, list_sort(list(x)) AS xs FROM fx_spans WHERE x + 20 > 550 GROUP BY ALL) SELECT sheet_id, CAST(CASE WHEN xs IS NULL THEN 700 ELSE greatest(550, least(800, floor(xs[len(xs) // 10 + 1] - 12))) END AS BIGINT) AS fallback FROM fx_sheets LEFT JOIN r USING (sheet_id)",
    "legend_rows": rf"""{with_views('spans')}, n AS (SELECT sheet_id, seq, regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[ :\-]+', ''), '[ :\-]+$', '') AS name FROM fx_spans)
SELECT * FROM n WHERE length(name) BETWEEN 3 AND 80 AND NOT regexp_matches(name, 'map\s*legend|^legend$|general notes|keynotes', 'i') AND NOT regexp_full_match(name, '[\d.\-]+') AND NOT regexp_matches(upper(name), '^({'|'.join(T.TITLE_BLOCK_WORDS)})( |$)')
  AND NOT regexp_full_match(name, '\d{{1,2}}/\d{{1,2}}/\d{{2,4}}') AND (regexp_matches(name, '^[A-Z0-9][A-Z0-9\s\-/&().%]{{2,60}}$') OR regexp_matches(upper(name), '{'|'.join(T.KNOWN_LABELS)}'))""",
    "room_windows": rf"""{with_views('spans')}, r AS (SELECT sheet_id, x, y FROM fx_spans WHERE regexp_full_match(text, '\d{{3}}')), c AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY sheet_id)),
d AS (SELECT *, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM c WHERE n >= 3), k AS (SELECT *, d <= greatest(180, 2.6 * median(d) OVER (PARTITION BY sheet_id)) AS near FROM d), e AS (SELECT *, count(*) FILTER (WHERE near) OVER (PARTITION BY sheet_id) AS m FROM k)
SELECT sheet_id, count(*) AS rooms, CAST(greatest(0, min(x) - 100) AS BIGINT) AS x0, CAST(greatest(0, min(y) - 100) AS BIGINT) AS y0, CAST(least(999, max(x) + 100) AS BIGINT) AS x1, CAST(least(999, max(y) + 100) AS BIGINT) AS y1 FROM e WHERE near OR m < 3 GROUP BY ALL""",
    "interior_shares": f"""{with_views('points')}, e(x1, y1, x2, y2) AS (VALUES {EDGES}), p AS (SELECT sheet_id, poly_seq, pos, x, y, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM fx_points, e GROUP BY ALL)
SELECT sheet_id, poly_seq, round(avg((inside AND NOT (x >= 300 AND x < 500 AND y >= 300 AND y < 450))::INT), 6) AS share FROM p GROUP BY ALL""",
    "view_windows": f"""{with_views('spans')}, d AS (SELECT sheet_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_spans GROUP BY ALL), q AS (SELECT sheet_id, min(x) AS px0, max(x) AS px1, min(y) AS py0, max(y) AS py1 FROM fx_spans WHERE text = 'TC' AND sheet_id LIKE '%2' GROUP BY ALL)
SELECT sheet_id, greatest(0, coalesce(px0, x0) - 20) AS x0, least(1000, coalesce(px1, x1) + 20) AS x1, greatest(0, coalesce(py0, y0) - 20) AS y0, least(900, coalesce(py1, y1) + 20) AS y1 FROM d LEFT JOIN q USING (sheet_id)""",
    "stage_statuses": f"""{with_views('spans', 'sheets')}, n AS (SELECT sheet_id, role, count(*) FILTER (WHERE text = 'TC') AS e, count(*) FILTER (WHERE seq % 50 = 0) AS p, count(*) FILTER (WHERE seq % 70 = 0) AS a FROM fx_spans JOIN fx_sheets USING (sheet_id) GROUP BY ALL)
SELECT sheet_id, CASE WHEN p > 0 THEN 'done' ELSE 'default' END AS scale, 'empty' AS legend, CASE WHEN e > 0 THEN 'done' ELSE 'empty' END AS elevations, CASE WHEN a > 0 THEN 'done' ELSE 'empty' END AS association,
  CASE WHEN role = 'existing' THEN 'deferred' WHEN p > 0 THEN 'done' ELSE 'failed' END AS cut_fill, CAST((p = 0)::INT + (e = 0)::INT + (p = 0)::INT + (p = 0 AND role = 'proposed')::INT + (e > 0 AND a > 0 AND a / e < 0.35)::INT + (role <> 'existing' AND a < 3)::INT AS INT) AS warnings FROM n""",
}
