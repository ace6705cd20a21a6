"""Queries of stages that build on others: strokes, site, legend, pixels, samples and frames, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracut.functions import geometry as G
from terracut.functions import text as T
from terracut.operators import elevations, layers, layout, legend, polylines, raster, site, strokes, styles, surfaces, volumes
from terracut.params import DEFAULTS, Params
from terracut.plans import cutfill
from terracut.plans.fixtures import view, with_views
from terracut.sources.scratch import kept
from terracut.plans.queries import EDGES, FUSED, METRICS, PROFILE, READ, READINGS, RING, parsed, r6
from terracut.plans.queries import DRAWN
from terracut.plans.queries import SQL as BASE
from terracut.sources import tables

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
VIEWPORT, CHROME = (100.0, 50.0, 900.0, 940.0), [(200.0, 100.0, 420.0, 300.0), (600.0, 500.0, 800.0, 980.0)]


def box_of(values: tuple[float, ...]) -> Column:
    return F.struct(*[F.lit(v).alias(k) for v, k in zip(values, ("x0", "y0", "x1", "y1"), strict=True)])


def titles(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "titles").select("sheet_id", "seq", "text", F.struct("x0", "y0", "x1", "y1").alias("bbox_px"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sheets").select("sheet_id", box_of((300.0, 200.0, 990.0, 980.0)).alias("legend_bbox"), box_of((0.0, 0.0, 600.0, 1000.0)).alias("drawing_bbox"))


def outlines(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    box = F.struct(*[F.lit(v).alias(k) for v, k in ((300, "x0"), (300, "y0"), (500, "x1"), (450, "y1"))])
    return view(spark, sf, "sheets").select("sheet_id", ring.alias("property_polygon"), F.lit(None).cast("array<struct<x: double, y: double>>").alias("building_polygon"), box.alias("building_bbox"))


def drawn_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Vector items in points, turned and zoomed to page pixels, inked and near the viewport."""
    point = lambda k: F.struct((F.col(f"x{k}") / 2).alias("x"), (F.col(f"y{k}") / 2).alias("y")).alias(f"p{k}")
    items = view(spark, sf, "segments").select("sheet_id", "seq", F.when(F.col("seq") % 7 == 0, "re").otherwise("l").alias("op"), F.array(F.col("color0"), F.col("color0") + 0.1, F.lit(0.5)).alias("color"), F.when(F.col("w") > 0, F.col("w")).alias("width"), point(1), point(2))
    s = strokes.segments(items, box_of((150.0, 100.0, 800.0, 700.0)), F.lit(2.0), [F.lit(float(v)) for v in (0, 1, -1, 0, 500, 0)])
    return s.select("sheet_id", "seq", r6("x1"), r6("y1"), r6("x2"), r6("y2"), r6("len"), r6("ang"), "w", "color0")


def border_strokes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "segments").select("sheet_id", "seq", strokes.near_border(F.lit(1000.0), F.lit(960.0), 40.0).alias("near"))


def chain_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Lines through given chains, the ten longest of each sheet."""
    lines = strokes.chain_lines(strokes.measured(view(spark, sf, "segments")).withColumn("chain", F.col("seq") % 97))
    top = strokes.longest(lines.withColumn("length", F.round("length", 6)), 10)
    return top.select("sheet_id", "chain", "members", r6("ang"), "length", r6("x1"), r6("y1"), r6("x2"), r6("y2"), "rank")


def viewport_readings(spark: SparkSession, sf: str) -> DataFrame:
    spans = view(spark, sf, "spans").join(view(spark, sf, "sheets"), "sheet_id")
    return elevations.read_elevations(spans, F.col("role"), DEFAULTS, box_of(VIEWPORT), F.array(*[box_of(b) for b in CHROME])).select("sheet_id", "seq", "value_ft", "confidence", "kind")


def deduped_callouts(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy dedupe where many callouts conflict."""
    coarse = parsed(spark, sf).withColumn("value_ft", F.floor(F.col("value_ft") / 20) * 20.0)
    return elevations.dedupe(coarse, Params(same_place=120.0)).select("sheet_id", "seq", "value_ft", "confidence", "kind")


def gated_callouts(spark: SparkSession, sf: str) -> DataFrame:
    """Clean callouts of drawings, with recognised texts on sheets whose spans give few."""
    spans = view(spark, sf, "spans")
    sheets = view(spark, sf, "sheets").select("sheet_id", "role", box_of(VIEWPORT).alias("drawing_bbox"), F.array(*[box_of(b) for b in CHROME]).alias("chrome_bboxes"))
    read = spans.select("sheet_id", (F.col("seq") + 10_000_000).alias("seq"), F.concat(F.lit("EL "), (950 + F.col("seq") % 9).cast("string"), F.lit(".5")).alias("text"), "x", "y", F.lit(0.75).alias("score")).where("seq % 5 = 0")
    few = F.col("sheet_id").endswith("3") & (F.col("seq") % 4 != 0)
    return elevations.elevations(spans.where(~few), sheets, DEFAULTS, read).select("sheet_id", "seq", "value_ft", "source", "confidence", "kind")


def property_outlines(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "samples").select(F.col("site_id").alias("sheet_id"), (F.col("seq") % 5).alias("chain"), F.col("x_ft").alias("x"), F.col("y_ft").alias("y"))
    o = site.property_outline(p.where("sheet_id != 'Brand#11' OR chain < 2"))
    return o.select("sheet_id", F.size("property_polygon").alias("corners"), *[F.col(f"property_bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def building_outlines(spark: SparkSession, sf: str) -> DataFrame:
    walls = view(spark, sf, "samples").select(F.col("site_id").alias("sheet_id"), (F.col("seq") % 7).alias("chain"), (20.0 + 10 * (F.col("seq") % 7)).alias("length"), (F.col("x_ft") + 0.5).alias("x"), (F.col("y_ft") + 0.25).alias("y"))
    tagged = view(spark, sf, "spans").select("sheet_id", T.anchor_tag(F.col("text")).alias("tag"), "x", "y")
    b = site.buildings(walls, tagged, F.lit(1000), F.lit(1000))
    return b.select("sheet_id", F.size("building_polygon").alias("corners"), *[F.col(f"building_bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def interior_zones(spark: SparkSession, sf: str) -> DataFrame:
    z = site.zones(outlines(spark, sf).withColumns({"width": F.lit(1000), "height": F.lit(900)}))
    return z.select("sheet_id", "seq", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def contour_filter(spark: SparkSession, sf: str) -> DataFrame:
    points, kinds = view(spark, sf, "points"), view(spark, sf, "kinds").withColumn("kind", F.when(F.col("poly_seq") % 11 == 0, "property").otherwise(F.col("kind")))
    rejected = view(spark, sf, "sheets").select("sheet_id", F.when(F.col("sheet_id").endswith("2"), F.array(F.lit("property_dashdot"), F.lit("building_solid"), F.lit("contour_dash"))).otherwise(F.array(F.lit("property_dashdot"), F.lit("building_solid"))).alias("styles"))
    return site.topo_filter(points, polylines.metrics(points), kinds, outlines(spark, sf), rejected)


def rejected_styles(spark: SparkSession, sf: str) -> DataFrame:
    named = titles(spark, sf).select("sheet_id", F.col("text").alias("name"))
    return legend.rejected_styles(named).select("sheet_id", F.concat_ws(",", "styles").alias("styles"))


def legend_flags(spark: SparkSession, sf: str) -> DataFrame:
    named = titles(spark, sf).select("sheet_id", F.col("text").alias("name"))
    return named.groupBy("sheet_id").agg(legend.has_label("CONTOUR").alias("contour"), legend.has_label("SILT").alias("silt"))


def legend_panel_rows(spark: SparkSession, sf: str) -> DataFrame:
    return legend.panel_rows(titles(spark, sf), panel(spark, sf)).select("sheet_id", "seq", "name")


def legend_entries(spark: SparkSession, sf: str) -> DataFrame:
    e = legend.legends(titles(spark, sf), panel(spark, sf))
    return e.select("sheet_id", "seq", "name", "symbol_hint", "source", F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"))


def icon_boxes(spark: SparkSession, sf: str) -> DataFrame:
    named = titles(spark, sf).select("sheet_id", "seq", F.col("text").alias("name"), F.col("bbox_px").alias("bbox"))
    whole = panel(spark, sf).withColumn("legend_bbox", F.when(~F.col("sheet_id").endswith("4"), F.struct(*[F.col(f"legend_bbox.{c}").cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])))
    i = legend.icon_boxes(named, whole, view(spark, sf, "sheets").withColumn("height_px", F.lit(995)))
    return i.select("sheet_id", "seq", *[F.col(f"icon.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def sheet_headers(spark: SparkSession, sf: str) -> DataFrame:
    h = layout.headers(titles(spark, sf), view(spark, sf, "sheets").withColumn("width_px", F.lit(1000)))
    return h.select("sheet_id", *[F.col(f"{name}.{c}").alias(f"{name}_{c}") for name in layout.HEADERS for c in ("x0", "y0")])


def sheet_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Drawing, panels and split of every sheet, from its texts."""
    t = layout.layouts(titles(spark, sf), view(spark, sf, "sheets").withColumns({"width_px": F.lit(1000), "height_px": F.lit(1000)}))
    boxes = [F.col(f"{name}_bbox.{c}").alias(f"{name}_{c}") for name in ("drawing", "legend", "notes", "title", "scale") for c in ("x0", "y0", "x1", "y1")]
    return t.select("sheet_id", "split", *boxes, F.size("chrome_bboxes").alias("panels"), "notes")


def gray_rows(spark: SparkSession, sf: str) -> DataFrame:
    row = F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: F.lpad(F.hex(p["v"]), 2, "0"))
    return view(spark, sf, "pixels").groupBy("sheet_id", "y").agg(F.unhex(F.concat_ws("", row)).alias("gray"))


def column_shares(spark: SparkSession, sf: str) -> DataFrame:
    boxes = gray_rows(spark, sf).select("sheet_id").distinct().select("sheet_id", F.struct(F.lit(5).alias("x0"), F.lit(1).alias("y0"), F.lit(30).alias("x1"), F.lit(20).alias("y1")).alias("box"))
    return raster.column_ink(gray_rows(spark, sf), boxes, styles.INK).select("sheet_id", "x", r6("share"))


def small_points(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "points").select(F.concat(F.lit("G"), F.col("poly_seq") % 5).alias("sheet_id"), "poly_seq", "pos", (F.col("x") % 43).alias("x"), (F.col("y") % 31).alias("y"))


def pixel_profiles(spark: SparkSession, sf: str) -> DataFrame:
    points = small_points(spark, sf)
    sheets = points.select("sheet_id").distinct().withColumns({"width_px": F.lit(40), "height_px": F.lit(30)})
    p = raster.profile_samples(points, polylines.metrics(points).withColumn("length_px", F.round("length_px", 6)), sheets, gray_rows(spark, sf))
    return p.select("sheet_id", "poly_seq", "pos", r6("gray"))


def gray_segments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Segments on the pages of the pixels view (40 x 30), and the pages."""
    s = view(spark, sf, "segments").where("seq % 23 = 0").select(F.concat(F.lit("G"), F.col("seq") % 5).alias("sheet_id"), "seq", (F.col("x1") % 41).alias("x1"), (F.col("y1") % 29).alias("y1"), (F.col("x2") % 37).alias("x2"), (F.col("y2") % 31).alias("y2"), "w", "color0")
    return strokes.measured(s), s.select("sheet_id").distinct().withColumns({"width_px": F.lit(40), "height_px": F.lit(30)})


def dash_patterns(spark: SparkSession, sf: str) -> DataFrame:
    m = raster.dash_measures(raster.segment_runs(*gray_segments(spark, sf), gray_rows(spark, sf)))
    return m.select("sheet_id", "seq", "places", r6("ink_ratio"), "inks", "gaps", "longs", "shorts", r6("ratio"), r6("spread"), r6("gap_mean"), F.coalesce(raster.is_long_short(), F.lit(False)).alias("long_short"))


def wall_strokes(spark: SparkSession, sf: str) -> DataFrame:
    m = raster.wall_measures(*gray_segments(spark, sf), gray_rows(spark, sf))
    return m.select("sheet_id", "seq", r6("ink_ratio"), r6("longest"), r6("mean_gray"), r6("axis"), raster.is_solid_wall().alias("wall"))


def page_crops(spark: SparkSession, sf: str) -> DataFrame:
    boxes = gray_rows(spark, sf).select("sheet_id").distinct().select("sheet_id", F.struct(F.lit(3).alias("x0"), F.lit(1).alias("y0"), F.lit(11).alias("x1"), F.lit(7).alias("y1")).alias("box"))
    return raster.cropped(gray_rows(spark, sf), boxes).select("sheet_id", "y", F.lower(F.hex("gray")).alias("gray"))


def drawing_pixels(spark: SparkSession, sf: str) -> DataFrame:
    inside = raster.in_drawing(F.col("x"), F.col("y"), box_of(VIEWPORT), F.array(*[box_of(b) for b in CHROME]))
    return view(spark, sf, "points").select("sheet_id", "poly_seq", "pos", inside.alias("inside"))


def contour_seeds(spark: SparkSession, sf: str) -> DataFrame:
    pixels = view(spark, sf, "points").select("sheet_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    roles = view(spark, sf, "sheets").withColumn("role", F.when(F.col("sheet_id").endswith("4"), "auto").otherwise(F.col("role")))
    return raster.select_seeds(parsed(spark, sf), pixels, roles).select("sheet_id", "seq", "sx", "sy", "kind", "z", r6("distance"), "rank")


def contour_sources(spark: SparkSession, sf: str) -> DataFrame:
    m = polylines.metrics(view(spark, sf, "points"))
    c = m.select("sheet_id", F.when(F.col("poly_seq") % 4 == 0, "skeleton_fallback").otherwise("seeded").alias("source"), F.round("length_px", 6).alias("length_px"), F.round(F.col("chord") / 20, 6).alias("end_gap"))
    counts = raster.contour_counts(c, parsed(spark, sf).where("kind != 'weak'")).withColumn("seeds_tried", F.col("seeds_hit") + 1)
    dropped = view(spark, sf, "kinds").groupBy("sheet_id").agg(F.count_if(F.col("kind") == "topo").alias("style_drop"), F.count_if(F.col("kind") == "structure").alias("rejected"))
    notes = layers.contour_notes(view(spark, sf, "kinds"), counts, dropped)
    return counts.join(notes, "sheet_id").select("sheet_id", "seeds_hit", "closed", "open", r6("mean_length"), "fallback", "existing_vs_proposed", F.size("notes").alias("notes"))


def seed_kinds(spark: SparkSession, sf: str) -> DataFrame:
    s = parsed(spark, sf).join(view(spark, sf, "kinds").select("sheet_id", F.col("poly_seq").alias("seq"), F.col("kind").alias("line")), ["sheet_id", "seq"])
    return s.select("sheet_id", "seq", raster.seed_kind(F.col("line"), F.col("kind"), F.col("value_ft")).alias("kind"))


def line_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Connected parts of ink by area: no specks, and without seeds no filled areas."""
    a = view(spark, sf, "segments").select("sheet_id", "seq", (F.col("seq") * 37 % 4001).alias("area"))
    both = [raster.component_area_limits(a, F.lit(1.5), F.lit(300), F.lit(200), seeded).withColumn("seeded", F.lit(seeded)) for seeded in (False, True)]
    return both[0].unionAll(both[1]).groupBy("sheet_id", "seeded").agg(F.count(F.lit(1)).alias("parts"), F.sum("area").alias("area"))


def hex_colors(spark: SparkSession, sf: str) -> DataFrame:
    c = layers.hex_color(F.concat(F.lit("#"), F.lpad(F.hex(F.col("seq") * 7919 % 16777216), 6, "0")))
    return view(spark, sf, "segments").select("sheet_id", "seq", *[c[k].alias(n) for k, n in enumerate(("blue", "green", "red"))])


def display_scales(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "segments").select("sheet_id", "seq", r6(layers.display_scale(F.col("seq"), F.lit(1600)), "scale"))


def lifted_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Points and boxes from the drawing's frame to the page's, and points back."""
    d = F.struct(F.lit(30).alias("x0"), F.lit(40).alias("y0"))
    s = view(spark, sf, "segments")
    b = site.lifted_box(F.when(F.col("seq") % 3 != 0, F.struct(*[F.col(c).alias(n) for c, n in (("x1", "x0"), ("y1", "y0"), ("x2", "x1"), ("y2", "y1"))])), d)
    ring = site.lifted_ring(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))), d)
    back = site.moved(ring[1]["x"], ring[1]["y"], d, -1)
    return s.select("sheet_id", "seq", *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")], ring[0]["x"].alias("px"), ring[0]["y"].alias("py"), back[0].alias("bx"), back[1].alias("by"))


def region_totals(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda k: F.struct((F.col("cut_cy") / k).alias("cut_cy"), (F.col("fill_cy") / (k + 1)).alias("fill_cy"))
    t = view(spark, sf, "truth").select(F.col("site_id").alias("job"), "cut_cy", "fill_cy", F.when(~F.col("site_id").endswith("5"), F.create_map(F.lit("pad"), pair(2), F.lit("road"), pair(4))).alias("regions"))
    return volumes.region_totals(t).select("job", "cut_cy", "fill_cy", r6("regions_cut_cy"), r6("regions_fill_cy"), "regions")


def callout_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    e = parsed(spark, sf)
    return e.select("sheet_id", "seq", surfaces.elevation_surface(F.col("kind"), True).alias("alone"), surfaces.elevation_surface(F.col("kind"), False).alias("fused"))


def final_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = view(spark, sf, "kinds").join(view(spark, sf, "sheets"), "sheet_id")
    return k.select("sheet_id", "poly_seq", styles.contour_kind(F.col("kind"), F.col("role")).alias("kind"))


def refined_templates(spark: SparkSession, sf: str) -> DataFrame:
    p = styles.profiles(view(spark, sf, "ink").select("stroke_id", "pos", "gray"), ["stroke_id"])
    names = F.when(F.col("stroke_id") == 3, "existing_contour").when(F.col("stroke_id") == 8, "property_line")
    t = styles.refined(styles.templates(spark), p.withColumn("name", names).where("name IS NOT NULL"))
    return t.select("place", "name", "dash_signature", *[r6(c) for c in ("ink_lo", "ink_hi", "tr_lo", "tr_hi", "gray_max")])


def fallback_samples(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "samples")
    few = s.where("surface = 'existing' OR site_id NOT LIKE '%3' OR seq % 3000 = 1")
    f = surfaces.with_fallback(few, s.select("site_id", "seq", "x_ft", "y_ft", (F.col("z") + 1).alias("z")))
    return f.groupBy("site_id", "surface").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("z"), "z"))


def sheet_tables(spark: SparkSession, sf: str, points: DataFrame, several: bool = False) -> cutfill.SheetTables:
    """What samples need of sheets, from the fixtures: callouts, contours of known kinds and their associations; stored if they are read several times."""
    from terracut.operators import associate

    once = kept if several else lambda df, name: df
    e = once(parsed(spark, sf), "callouts")
    lines = view(spark, sf, "kinds").join(view(spark, sf, "sheets"), "sheet_id").select("sheet_id", "poly_seq", styles.contour_kind(F.col("kind"), F.col("role")).alias("kind")).where("kind IS NOT NULL")
    lines = once(lines, "contours")
    scales = view(spark, sf, "sheets").select("sheet_id", (10.0 + F.length("sheet_id")).alias("ft_per_inch"))
    found = associate.associate(e, points.join(lines, polylines.KEY, "left_semi"), lines, 20.0)
    return cutfill.SheetTables(None, scales, e, lines, once(found, "associations"))


def sheet_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of all sheets: callouts, points of their contours and the feet on them, and a looser search on existing sheets."""
    points = kept(view(spark, sf, "points"), "points")
    s = cutfill.sample_rows(sheet_tables(spark, sf, points, True), points, view(spark, sf, "sheets"), True)
    return s.groupBy("sheet_id", "surface").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x"), "x"), r6(F.sum("y"), "y"), r6(F.sum("z"), "z"))


def framed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = sheet_tables(spark, sf, view(spark, sf, "points"))
    sheets = view(spark, sf, "sheets").select("sheet_id", F.concat(F.lit("site "), "sheet_id").alias("site_id"), F.lit(100).alias("dpi"), F.lit(1000).alias("width_px"), F.lit(900).alias("height_px"))
    box = lambda *v: F.struct(*[F.lit(x).alias(c) for x, c in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    known = view(spark, sf, "sheets").select("sheet_id", F.when(F.col("sheet_id").endswith("1"), box(100, 120, 700, 820)).alias("property_bbox"), F.when(~F.col("sheet_id").endswith("3"), box(300, 200, 500, 460)).alias("building_bbox"))
    samples = view(spark, sf, "samples").select(F.col("site_id").alias("sheet_id"), "surface", "seq", F.col("x_ft").alias("x"), F.col("y_ft").alias("y"), "z")
    return cutfill.to_feet(samples, sheets, t, known)


def site_feet(spark: SparkSession, sf: str) -> DataFrame:
    return framed(spark, sf)[0].select("site_id", "surface", "seq", r6("x_ft"), r6("y_ft"), "z")


def site_frames(spark: SparkSession, sf: str) -> DataFrame:
    return framed(spark, sf)[1].select("site_id", r6("w"), r6("h"))


def fused_statuses(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "samples").withColumn("x_ft", F.col("x_ft") - 500).withColumn("y_ft", F.col("y_ft") - 500)
    f = surfaces.fuse_samples(s, s, view(spark, sf, "frames"))
    v = view(spark, sf, "truth").select("site_id", (F.col("fill_cy") > 0).alias("ok"))
    return layers.fused_status(v, f).select("site_id", "cut_fill", "existing_vs_proposed", F.size("warnings").alias("warnings"))


def truth_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports as JSON text, read back."""
    pair = F.struct((F.col("cut_cy") / 2).alias("cut_cy"), F.lit(1.5).alias("fill_cy"))
    t = view(spark, sf, "truth").select(F.to_json(F.struct(F.col("site_id").alias("job"), "cut_cy", "fill_cy", F.create_map(F.lit("pad"), pair).alias("regions"), F.struct(F.lit(505.0).alias("stripping_cy")).alias("excluded_from_headline"))).alias("text"))
    r = t.select(tables.parse_truth(F.col("text")).alias("r")).select("r.*")
    return r.select("job", "cut_cy", "fill_cy", "notes", F.col("regions")["pad"]["cut_cy"].alias("pad_cut"), "excluded_from_headline.stripping_cy", "excluded_from_headline.sectional_cy")


def swatch_patterns(spark: SparkSession, sf: str) -> DataFrame:
    p = raster.swatch_profiles(gray_rows(spark, sf), "sheet_id")
    return p.select("sheet_id", "pattern", r6("ink_ratio"), r6("trans_rate"), r6("mean_gray"))


def site_regions(spark: SparkSession, sf: str) -> DataFrame:
    whole = lambda name: F.struct(*[F.col(f"{name}.{c}").cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    none = F.lit(None).cast("struct<x0: int, y0: int, x1: int, y1: int>")
    p = panel(spark, sf).select("sheet_id", whole("legend_bbox").alias("legend_bbox"), whole("drawing_bbox").alias("drawing_bbox"), F.when(F.col("sheet_id").endswith("1"), whole("legend_bbox")).alias("notes_bbox"), none.alias("title_bbox"), none.alias("scale_bbox"))
    found = outlines(spark, sf).select("sheet_id", F.when(F.col("sheet_id").endswith("2"), F.col("building_bbox")).alias("property_bbox"), "building_bbox")
    zone = view(spark, sf, "sheets").select("sheet_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq")).withColumn("bbox", F.struct(*[(F.col("seq") * 7 + k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]))
    r = layout.with_site(layout.regions(p), found, zone)
    return r.select("sheet_id", "seq", "name", F.col("bbox.x0").alias("x0"), F.col("bbox.y1").alias("y1"), "color", "role")


def shifted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sheets, spans and drawings of the sheets that the dashes view draws."""
    sheet = F.concat(F.lit("S"), F.col("seq") % 5)
    spans = view(spark, sf, "spans").select(sheet.alias("sheet_id"), "seq", "text", "x", "y")
    sheets = spans.select("sheet_id").distinct().withColumn("role", F.when(F.col("sheet_id") == "S3", "existing").otherwise("proposed"))
    return sheets, spans, sheets.select("sheet_id", F.struct(F.lit(20).alias("x0"), F.lit(30).alias("y0"), F.lit(960).alias("x1"), F.lit(900).alias("y1")).alias("drawing_bbox"))


def site_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Property and building of every sheet, from strokes and room labels."""
    sheets, spans, plan = shifted(spark, sf)
    s, _ = site.site_structure(strokes.measured(view(spark, sf, "dashes")), spans, spans.limit(0), plan, sheets)
    box = lambda name, short: [F.col(f"{name}_bbox.{c}").alias(f"{short}{c}") for c in ("x0", "y0", "x1", "y1")]
    return s.select("sheet_id", F.size("property_polygon").alias("corners"), *box("property", "p"), F.col("building_polygon").isNotNull().alias("built"), *box("building", "b"), "n_property", "n_building", "notes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        drawn_segments, border_strokes, chain_ends, viewport_readings, deduped_callouts, gated_callouts, property_outlines, building_outlines, interior_zones, contour_filter, rejected_styles, legend_flags,
        legend_panel_rows, legend_entries, icon_boxes, sheet_headers, column_shares, pixel_profiles, drawing_pixels, contour_seeds, contour_sources, seed_kinds, line_parts, hex_colors, display_scales, lifted_frames,
        region_totals, callout_surfaces, final_kinds, refined_templates, fallback_samples, sheet_samples, site_feet, site_frames, fused_statuses,
        truth_reports, swatch_patterns, site_regions, site_outlines, sheet_layouts, dash_patterns, wall_strokes, page_crops,
    )
}

INSIDE = "x BETWEEN 100 AND 900 AND y BETWEEN 50 AND 940 AND NOT (x BETWEEN 200 AND 420 AND y BETWEEN 100 AND 300) AND NOT (x BETWEEN 600 AND 800 AND y BETWEEN 500 AND 980)"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def greedy_sql(source: str, place: float) -> str:
    """kept: what stays of source (sheet_id, seq, x, y, value_ft, confidence) when each is dropped by a surer (then earlier) one that stays, near in place and value."""
    return f"""
ord AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY confidence DESC, seq) AS k FROM {source}),
gre AS (SELECT sheet_id, 0::BIGINT AS k, []::STRUCT(x DOUBLE, y DOUBLE, v DOUBLE, seq BIGINT)[] AS stay FROM (SELECT DISTINCT sheet_id FROM ord)
  UNION ALL SELECT g.sheet_id, o.k, CASE WHEN len(list_filter(g.stay, lambda q: abs(q.x - o.x) < {place} AND abs(q.y - o.y) < {place} AND abs(q.v - o.value_ft) < 0.05)) > 0 THEN g.stay
    ELSE list_append(g.stay, struct_pack(x := o.x, y := o.y, v := o.value_ft::DOUBLE, seq := o.seq)) END FROM gre g JOIN ord o ON o.sheet_id = g.sheet_id AND o.k = g.k + 1),
kept AS (SELECT ord.* EXCLUDE (k) FROM ord JOIN (SELECT sheet_id, unnest(list_transform(arg_max(stay, k), lambda q: q.seq)) AS seq FROM gre GROUP BY sheet_id) USING (sheet_id, seq))"""


PADS = """
cen AS (SELECT *, round_even(value_ft, 2) AS lv, count(*) OVER w AS n, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM kept WHERE role <> 'existing' WINDOW w AS (PARTITION BY sheet_id, round_even(value_ft, 2))),
rnk AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, lv ORDER BY pow(x - cx, 2) + pow(y - cy, 2), seq) AS k FROM cen),
pad AS (SELECT sheet_id, seq, value_ft, source, CASE WHEN n >= 5 THEN least(confidence, 0.7) ELSE confidence END::DOUBLE AS confidence, CASE WHEN n >= 5 THEN 'ffe' ELSE kind END AS kind FROM rnk WHERE n < 5 OR k = 1
  UNION ALL SELECT sheet_id, seq, value_ft, source, confidence::DOUBLE, kind FROM kept WHERE role = 'existing'),
fin AS (SELECT *, count(*) OVER (PARTITION BY sheet_id) AS n, median(value_ft) OVER (PARTITION BY sheet_id) AS m FROM pad)"""
CLEAN = "SELECT sheet_id, seq, value_ft, {} confidence, kind FROM fin WHERE n < 5 OR abs(value_ft - m) <= 25"
# Directed hull edges of distinct points p(key, x, y), by brute force: no point to their right, and none beyond on the line.
HULL = """
hed AS (SELECT a.{key} AS key, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON a.{key} = b.{key} AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.{key} = a.{key} AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
  OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (pow(c.x - a.x, 2) + pow(c.y - a.y, 2) > pow(b.x - a.x, 2) + pow(b.y - a.y, 2) OR (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) < 0)))))"""
KNOWN = "|".join(T.KNOWN_LABELS)
NAME = r"regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[ :\-]+', ''), '[ :\-]+$', '')"
IS_ROW = rf"""length(name) BETWEEN 3 AND 80 AND NOT regexp_matches(name, 'map\s*legend|^legend$|general notes|keynotes', 'i') AND NOT regexp_full_match(name, '[\d.\-]+') AND NOT regexp_matches(upper(name), '^({'|'.join(T.TITLE_BLOCK_WORDS)})( |$)')
  AND NOT regexp_full_match(name, '\d{{1,2}}/\d{{1,2}}/\d{{2,4}}') AND (regexp_matches(name, '^[A-Z0-9][A-Z0-9\s\-/&().%]{{2,60}}$') OR regexp_matches(upper(name), '{KNOWN}'))"""
PANEL = f"""
pan AS (SELECT * FROM fx_titles WHERE x0 + 40 BETWEEN 300 AND 990 AND y0 + 6 BETWEEN 200 AND 980),
hdr AS (SELECT sheet_id, arg_min(y1, seq) AS start FROM pan WHERE regexp_matches(text, 'legend', 'i') GROUP BY ALL),
nam AS (SELECT pan.*, {NAME} AS name FROM pan LEFT JOIN hdr USING (sheet_id) WHERE y0 >= coalesce(start, 0) - 2),
row_ AS (SELECT * FROM nam WHERE {IS_ROW} QUALIFY row_number() OVER (PARTITION BY sheet_id, upper(name) ORDER BY y0, x0, seq) = 1)"""
HINTS = "\n".join("  WHEN " + " AND ".join(f"contains(u, '{w}')" for w in words) + f" THEN '{hint}'" for words, hint in T.SYMBOL_HINTS)
TITLED = ", ".join(f"({i}, '{name}', '{name.title()}')" for i, name in enumerate(T.KNOWN_LABELS))
SAME = "(contains(upper(e.name), {0}) OR contains({0}, upper(e.name)))"
ENTRIES = f"""{PANEL},
fol AS (SELECT sheet_id, list_reduce(list([struct_pack(name := name, x := x0, y := y0, source := 'pdf_legend_panel')] ORDER BY y0, x0, seq), lambda acc, r:
  CASE WHEN length(r[1].name) <= 12 AND NOT regexp_matches(upper(r[1].name), '{KNOWN}') AND length(acc[-1].name) <= 16 AND NOT regexp_matches(upper(acc[-1].name), '{KNOWN}')
  THEN list_append(acc[:-2], struct_pack(name := acc[-1].name || ' ' || r[1].name, x := acc[-1].x, y := acc[-1].y, source := 'pdf_legend_panel')) ELSE list_concat(acc, r) END) AS entries FROM row_ GROUP BY sheet_id),
lab(place, label, title) AS (VALUES {TITLED}),
ahd AS (SELECT *, concat_ws(' ', upper(text), lead(upper(text), 1) OVER w, lead(upper(text), 2) OVER w) AS t FROM fx_titles WINDOW w AS (PARTITION BY sheet_id ORDER BY seq)),
fnd AS (SELECT sheet_id, place, label, title, arg_min(x0, seq) FILTER (WHERE contains(upper(text), label)) AS x, arg_min(y0, seq) FILTER (WHERE contains(upper(text), label)) AS y FROM ahd JOIN lab ON contains(t, label) GROUP BY ALL),
ext AS (SELECT sheet_id, list([struct_pack(name := title, x := x, y := y, source := 'pdf_keyword')] ORDER BY place) AS extra FROM fnd GROUP BY ALL),
too AS (SELECT s.sheet_id, list_reduce(list_prepend(coalesce(entries, []), coalesce(extra, [])), lambda acc, r:
  CASE WHEN len(list_filter(acc, lambda e: {SAME.format('upper(r[1].name)')})) > 0 THEN acc ELSE list_concat(acc, r) END) AS every FROM (SELECT DISTINCT sheet_id FROM fx_titles) s LEFT JOIN fol USING (sheet_id) LEFT JOIN ext USING (sheet_id)),
ded AS (SELECT sheet_id, list_reduce(list_prepend(every[:0], list_transform(every, lambda e: [e])), lambda acc, r: CASE WHEN len(list_filter(acc, lambda d: upper(d.name) = upper(r[1].name))) > 0
  OR (len(list_filter(acc, lambda d: abs(length(d.name) - length(r[1].name)) < 12 AND (contains(upper(d.name), upper(r[1].name)) OR contains(upper(r[1].name), upper(d.name))))) > 0
    AND len(list_filter(acc, lambda d: upper(d.name) <> upper(r[1].name) AND contains(upper(d.name), upper(r[1].name)))) > 0) THEN acc ELSE list_concat(acc, r) END) AS final FROM too),
flat AS (SELECT sheet_id, i - 1 AS seq, final[i] AS e FROM ded, unnest(range(1, len(final) + 1)) t(i))"""
# Like LINES of the associations, with kinds after the last cleanup and any reach.
FOUND = r"""
knd AS (SELECT k.sheet_id, poly_seq, CASE WHEN kind IN ('existing', 'proposed') THEN kind WHEN role = 'existing' THEN 'existing' ELSE 'proposed' END AS kind FROM fx_kinds k JOIN fx_sheets USING (sheet_id) WHERE kind NOT IN ('structure', 'property', 'building')),
usable AS (SELECT *, bool_or(kind = 'existing') OVER w AS has_existing, bool_or(kind = 'proposed') OVER w AS has_proposed FROM knd WINDOW w AS (PARTITION BY sheet_id)),
steps AS (SELECT sheet_id, poly_seq, pos, x AS x1, y AS y1, coalesce(x2, x) AS x2, coalesce(y2, y) AS y2 FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fx_points WINDOW w AS (PARTITION BY sheet_id, poly_seq ORDER BY pos)) WHERE x2 IS NOT NULL OR pos = 0),
met AS (SELECT e.sheet_id, e.seq, e.value_ft AS z, role, u.kind AS poly_kind, s.poly_seq, s.pos, e.x, e.y, x1, y1, x2, y2, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS size FROM parsed e JOIN usable u USING (sheet_id) JOIN steps s USING (sheet_id, poly_seq)
  WHERE CASE WHEN e.kind = 'existing_match' AND has_existing THEN u.kind = 'existing' WHEN e.kind IN ('spot', 'ffe') AND has_proposed THEN u.kind = 'proposed' ELSE true END),
foot AS (SELECT *, CASE WHEN size < 1e-9 THEN 0.0 ELSE greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / size)) END AS t FROM met),
near AS (SELECT *, x1 + t * (x2 - x1) AS fx, y1 + t * (y2 - y1) AS fy, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS distance FROM foot),
best AS (SELECT *, CASE WHEN role = 'existing' OR poly_kind = 'existing' THEN 'existing' ELSE 'proposed' END AS surface FROM near QUALIFY row_number() OVER (PARTITION BY sheet_id, seq ORDER BY round(distance, 9), poly_seq, pos) = 1),
tight AS (SELECT * FROM best WHERE distance <= 20),
sparse AS (SELECT sheet_id FROM (SELECT sheet_id, role, count(*) AS n FROM parsed GROUP BY ALL) LEFT JOIN (SELECT sheet_id, count(*) AS a FROM tight GROUP BY ALL) USING (sheet_id) WHERE role = 'existing' AND coalesce(a, 0) < greatest(3, n // 2)),
sized AS (SELECT *, count(*) OVER (PARTITION BY sheet_id, poly_seq) AS n FROM fx_points),
smp AS (SELECT sheet_id, CASE WHEN role = 'existing' THEN 'existing' WHEN kind = 'existing_match' THEN 'existing' WHEN kind IN ('ffe', 'spot', 'weak') THEN 'proposed' END AS surface, x, y, value_ft AS z FROM parsed
  UNION ALL SELECT b.sheet_id, surface, p.x, p.y, z FROM tight b JOIN sized p USING (sheet_id, poly_seq) WHERE p.pos % greatest(1, n // CASE WHEN role = 'existing' THEN 8 ELSE 6 END) = 0
  UNION ALL SELECT sheet_id, surface, fx, fy, z FROM tight
  UNION ALL SELECT b.sheet_id, surface, p.x, p.y, z FROM best b JOIN sparse USING (sheet_id) JOIN sized p USING (sheet_id, poly_seq) WHERE distance <= 280 AND p.pos % greatest(1, n // 10) = 0)"""
FRAMES = """
fr AS (SELECT sheet_id, 'site ' || sheet_id AS site_id, (10.0 + length(sheet_id)) / 100 AS ft, CASE WHEN sheet_id LIKE '%1' THEN 400 WHEN sheet_id NOT LIKE '%3' THEN 400 ELSE 500 END AS ox,
  CASE WHEN sheet_id LIKE '%1' THEN 470 WHEN sheet_id NOT LIKE '%3' THEN 330 ELSE 450 END AS oy, CASE WHEN sheet_id LIKE '%1' THEN 600 ELSE 500 END AS w, CASE WHEN sheet_id LIKE '%1' THEN 700 ELSE 450 END AS h FROM fx_sheets)"""


# Places along the segments on the pixels view's pages, {n} of each, and runs of ink.
ALONG = """
s AS (SELECT 'G' || (seq % 5) AS sheet_id, seq, x1 % 41 AS x1, y1 % 29 AS y1, x2 % 37 AS x2, y2 % 31 AS y2 FROM fx_segments WHERE seq % 23 = 0),
m AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len, degrees(atan2(y2 - y1, x2 - x1)) AS a0 FROM s),
pl AS (SELECT sheet_id, seq, i AS pos, CAST(trunc(greatest(0.0, least(39.0, x1 + i * (x2 - x1) / greatest(n - 1, 1)))) AS INT) AS px, CAST(trunc(greatest(0.0, least(29.0, y1 + i * (y2 - y1) / greatest(n - 1, 1)))) AS INT) AS py
  FROM (SELECT *, CAST({n} AS INT) AS n FROM m), unnest(range(n)) t(i)),
al AS (SELECT pl.sheet_id, seq, pos, max(v) FILTER (WHERE x = px AND y = py) AS gray, min(v) AS darkest FROM pl JOIN fx_pixels q ON q.sheet_id = pl.sheet_id AND x BETWEEN px - 1 AND px + 1 AND y BETWEEN py - 1 AND py + 1 GROUP BY ALL)"""
RUNS = """
ch AS (SELECT *, darkest < 165 AS ink, CASE WHEN (darkest < 165) = (lag(darkest) OVER w < 165) THEN 0 ELSE 1 END AS c FROM al WINDOW w AS (PARTITION BY sheet_id, seq ORDER BY pos)),
ri AS (SELECT *, sum(c) OVER (PARTITION BY sheet_id, seq ORDER BY pos) AS run FROM ch), ru AS (SELECT sheet_id, seq, run, ink, count(*) AS size FROM ri GROUP BY ALL)"""


def any_of(words: list[str], text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def clamped(x0: str, y0: str, x1: str, y1: str) -> str:
    """A box in whole pixels of a page of 1000 x 1000."""
    cut = lambda v: f"CAST(greatest(0, least(1000, trunc({v}))) AS INT)"
    side = lambda a, b, lo, hi: f"{lo} := least({a}, {b}), {hi} := CASE WHEN {a} = {b} THEN least({a} + 1, 1000) ELSE greatest({a}, {b}) END"
    return f"struct_pack({side(cut(x0), cut(x1), 'x0', 'x1')}, {side(cut(y0), cut(y1), 'y0', 'y1')})"


def below(head: str, k: int) -> str:
    """The panel from a header down to the next one."""
    y0, after = f"floor(greatest(0, {head}.y0 - 10))", f"list_filter(ys, lambda p: p.y > {head}.y0 OR (p.y = {head}.y0 AND p.k > {k}))"
    y1 = f"coalesce(floor({after}[1].y - 6), 1000)"
    if k == 0:
        y1 = f"CASE WHEN legend.y0 > {y0} THEN least({y1}, legend.y0 - 4) ELSE {y1} END"
    return f"CASE WHEN {head} IS NOT NULL THEN {clamped('split', y0, '1000', f'greatest({y1}, {y0} + 48)')} END"


LAYOUT = f"""
hd AS (SELECT sheet_id, {", ".join(f"arg_min(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1), struct_pack(a := x0 <= 500, y := y0, s := seq)) FILTER (WHERE {any_of(words, 'upper(trim(text))')}) AS {name}" for name, words in layout.HEADERS.items())} FROM fx_titles GROUP BY ALL),
lh AS (SELECT *, coalesce(map_legend, any_legend) AS head FROM hd),
sp AS (SELECT s.*, head, title, regexp_replace(upper(trim(text)), '\\s+', ' ', 'g') AS t, y0 >= head.y1 - 2 AND x0 >= greatest(580, head.x0 - 120) AS rail FROM fx_titles s JOIN lh USING (sheet_id) WHERE head IS NOT NULL),
fl AS (SELECT *, rail AND {any_of(layout.ENTRY_LABELS)} AS entry, rail AND x0 <= head.x1 + 280 AND y0 <= head.y1 + 450 AS col, y0 > head.y1 + 80 AND x0 >= 500 AND {any_of(layout.STOPPERS)} AS stops FROM sp),
ag AS (SELECT sheet_id, any_value(head) AS head, any_value(title) AS title, min(x0) FILTER (WHERE entry) AS ex0, max(x1) FILTER (WHERE entry) AS ex1, min(y0) FILTER (WHERE entry) AS ey0, max(y1) FILTER (WHERE entry) AS ey1,
  min(x0) FILTER (WHERE col) AS cx0, max(x1) FILTER (WHERE col) AS cx1, max(y1) FILTER (WHERE col) AS cy1, min(floor(y0 - 10)) FILTER (WHERE stops) AS stop FROM fl GROUP BY sheet_id),
ed AS (SELECT *, CASE WHEN ex0 IS NOT NULL THEN least(ex0, coalesce(cx0, ex0)) ELSE coalesce(cx0, head.x0) END AS lft, CASE WHEN ex0 IS NOT NULL THEN ex1 ELSE coalesce(cx1, greatest(head.x1, head.x0 + 200)) END AS rgt,
  CASE WHEN ex0 IS NOT NULL THEN least(head.y0 - 8, ey0 - 8) ELSE head.y0 - 8 END AS top, CASE WHEN ex0 IS NOT NULL THEN greatest(ey1 + 40, coalesce(cy1 + 28, ey1 + 40)) ELSE coalesce(cy1 + 28, head.y1 + 280) END AS bot,
  least(stop, CASE WHEN title.y0 > head.y1 + 80 THEN floor(title.y0 - 10) END) AS end_ FROM ag),
sw AS (SELECT *, least(bot, coalesce(end_, bot)) AS bottom, greatest(lft - greatest(120, least(least(280, greatest(120, head.x0 - 680)), 70)), head.x0 - 220, 620) AS swatch FROM ed),
lg AS (SELECT sheet_id, {clamped('greatest(floor(least(greatest(swatch, 600, head.x0 - 260), swatch) - 10), 580)', 'greatest(0, least(top, head.y0 - 24))', 'least(1000, greatest(rgt, head.x1) + 40)', 'least(1000, greatest(bottom, head.y1 + 80))')} AS legend FROM sw),
rl AS (SELECT sheet_id, list_sort(list(x0)) AS xs FROM fx_titles WHERE x0 + 40 > 550 GROUP BY ALL),
j AS (SELECT s.sheet_id, lh.* EXCLUDE (sheet_id), legend, CASE WHEN xs IS NULL THEN 700 ELSE greatest(550, least(800, floor(xs[len(xs) // 10 + 1] - 12))) END AS fallback FROM fx_sheets s LEFT JOIN lh USING (sheet_id) LEFT JOIN lg USING (sheet_id) LEFT JOIN rl USING (sheet_id)),
sl AS (SELECT *, least(legend.x0, CASE WHEN notes.x0 > 550 THEN floor(notes.x0 - 200) END, CASE WHEN title.x0 > 550 THEN floor(title.x0 - 200) END, CASE WHEN head.x0 > 550 THEN floor(head.x0 - 200) END) AS edge FROM j),
st AS (SELECT *, CAST(CASE WHEN edge IS NULL THEN fallback ELSE floor(greatest(620, least(edge, 820))) END AS INT) AS split,
  list_sort(list_filter([struct_pack(y := notes.y0, k := 0), struct_pack(y := head.y0, k := 1), struct_pack(y := title.y0, k := 2)], lambda p: p.y IS NOT NULL)) AS ys FROM sl),
pn AS (SELECT *, {below('notes', 0)} AS notes_box, coalesce({below('title', 2)}, {clamped('split', '620', '1000', '1000')}) AS title_box FROM st),
al AS (SELECT *, CASE WHEN legend IS NOT NULL THEN {clamped('least(legend.x0, split)', 'legend.y0', '1000', 'greatest(least(legend.y1, title_box.y0 - 4), legend.y0 + 48)')} END AS legend_box,
  CASE WHEN scale IS NOT NULL THEN {clamped('floor(greatest(split, scale.x0 - 40))', 'floor(scale.y0 - 20)', 'floor(least(1000, scale.x1 + 220))', 'floor(scale.y1 + 40)')} END AS scale_box, {clamped('0', '0', 'split', '1000')} AS drawing_box FROM pn)"""

SQL = {
    "sheet_layouts": f"{with_views('titles', 'sheets')},{LAYOUT} SELECT sheet_id, split, " + ", ".join(f"{name}_box.{c} AS {name}_{c}" for name in ("drawing", "legend", "notes", "title", "scale") for c in ("x0", "y0", "x1", "y1")) + ", CAST((legend_box IS NOT NULL)::INT + (notes_box IS NOT NULL)::INT + 1 + (scale_box IS NOT NULL)::INT AS INT) AS panels, 'right rail @ x=' || split || '; legend=' || CASE WHEN legend IS NOT NULL THEN 'full' ELSE 'miss' END AS notes FROM al",
    "drawn_segments": f"""{with_views('segments')}, p AS (SELECT *, (500 - y1 / 2) * 2 AS a, x1 AS b, (500 - y2 / 2) * 2 AS c, x2 AS d FROM fx_segments WHERE seq % 7 <> 0 AND least(color0, color0 + 0.1, 0.5) <= 0.55 AND sqrt(pow(x1 / 2 - x2 / 2, 2) + pow(y1 / 2 - y2 / 2, 2)) >= 0.8),
q AS (SELECT sheet_id, seq, a AS x1, b AS y1, c AS x2, d AS y2, w, color0, sqrt(pow(c - a, 2) + pow(d - b, 2)) AS len, degrees(atan2(d - b, c - a)) AS a0 FROM p)
SELECT sheet_id, seq, x1, y1, x2, y2, round(len, 6) AS len, round(a0 - 180 * floor(a0 / 180), 6) AS ang, w, color0 FROM q WHERE len >= 1.2 AND (x1 + x2) / 2 BETWEEN 142 AND 808 AND (y1 + y2) / 2 BETWEEN 92 AND 708""",
    "border_strokes": f"{with_views('segments')} SELECT sheet_id, seq, least(x1, x2, y1, y2) < 40 OR greatest(x1, x2) > 960 OR greatest(y1, y2) > 920 AS near FROM fx_segments",
    "chain_ends": f"""{with_views('segments')}, s AS (SELECT *, seq % 97 AS chain, degrees(atan2(y2 - y1, x2 - x1)) AS a0 FROM fx_segments), a AS (SELECT *, a0 - 180 * floor(a0 / 180) AS ang FROM s),
b AS (SELECT sheet_id, chain, count(*) AS members, median(ang) AS ang, avg((x1 + x2) / 2) AS cx, avg((y1 + y2) / 2) AS cy FROM a GROUP BY ALL),
e AS (SELECT sheet_id, chain, unnest([x1, x2]) AS x, unnest([y1, y2]) AS y FROM a),
t AS (SELECT b.*, min((x - cx) * cos(radians(ang)) + (y - cy) * sin(radians(ang))) AS lo, max((x - cx) * cos(radians(ang)) + (y - cy) * sin(radians(ang))) AS hi FROM e JOIN b USING (sheet_id, chain) GROUP BY ALL)
SELECT sheet_id, chain, members, round(ang, 6) AS ang, round(hi - lo, 6) AS length, round(cx + lo * cos(radians(ang)), 6) AS x1, round(cy + lo * sin(radians(ang)), 6) AS y1, round(cx + hi * cos(radians(ang)), 6) AS x2, round(cy + hi * sin(radians(ang)), 6) AS y2,
  row_number() OVER (PARTITION BY sheet_id ORDER BY round(hi - lo, 6) DESC, chain) AS rank FROM t QUALIFY rank <= 10""",
    "viewport_readings": f"{READINGS} SELECT sheet_id, seq, value_ft, confidence, kind FROM parsed WHERE {INSIDE}",
    "deduped_callouts": recursive(f"{READINGS}, lev AS (SELECT * REPLACE (floor(value_ft / 20) * 20.0 AS value_ft) FROM parsed),{greedy_sql('lev', 120.0)} SELECT sheet_id, seq, value_ft, confidence, kind FROM kept"),
    "elevations_clean": recursive(f"{READINGS}, src AS (SELECT *, 'pdf_text' AS source FROM parsed),{greedy_sql('src', 12.0)},{PADS.replace(chr(39) + 'existing' + chr(39), chr(39) + 'none' + chr(39))} {CLEAN.format('')}"),
    "gated_callouts": recursive(f"""{with_views('spans', 'sheets').replace('fx_spans AS', 'fx_all AS')}, fx_spans AS (SELECT * FROM fx_all WHERE NOT (sheet_id LIKE '%3' AND seq % 4 <> 0)),{READ},
red AS (SELECT sheet_id, seq, x, y, role, value_ft, kind, confidence FROM parsed WHERE {INSIDE}),
ocr AS (SELECT sheet_id, seq + 10000000 AS seq, x, y, role, 950 + seq % 9 + 0.5 AS value_ft, CASE WHEN role = 'existing' THEN 'existing_match' ELSE 'spot' END AS kind, 0.75 AS confidence FROM fx_all JOIN fx_sheets USING (sheet_id)
  WHERE seq % 5 = 0 AND x BETWEEN 100 AND 900 AND y BETWEEN 50 AND 940 AND sheet_id NOT IN (SELECT sheet_id FROM red GROUP BY sheet_id HAVING count(*) >= 8)),
src AS (SELECT *, 'pdf_text' AS source FROM red UNION ALL SELECT *, 'ocr' FROM ocr),{greedy_sql('src', 12.0)},{PADS} {CLEAN.format('source,')}"""),
    "property_outlines": f"""{with_views('samples')}, q AS (SELECT site_id, seq % 5 AS chain, x_ft AS x, y_ft AS y FROM fx_samples WHERE site_id <> 'Brand#11' OR seq % 5 < 2), p AS (SELECT DISTINCT site_id, x, y FROM q),{HULL.format(key='site_id')},
c AS (SELECT key AS site_id, count(DISTINCT (ax, ay)) AS corners FROM hed GROUP BY ALL)
SELECT site_id AS sheet_id, CAST(CASE WHEN count(DISTINCT chain) >= 3 AND any_value(corners) >= 3 THEN any_value(corners) END AS INT) AS corners, CAST(min(x) AS INT) AS x0, CAST(min(y) AS INT) AS y0, CAST(max(x) AS INT) AS x1, CAST(max(y) AS INT) AS y1 FROM q LEFT JOIN c USING (site_id) GROUP BY ALL""",
    "building_outlines": rf"""{with_views('spans', 'samples')}, rom AS (SELECT sheet_id, x, y FROM fx_spans WHERE regexp_full_match(text, '\d{{3}}')), c AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy, count(*) OVER w AS n FROM rom WINDOW w AS (PARTITION BY sheet_id)),
d AS (SELECT *, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM c WHERE n >= 3), k AS (SELECT *, d <= greatest(180, 2.6 * median(d) OVER (PARTITION BY sheet_id)) AS near FROM d), e AS (SELECT *, count(*) FILTER (WHERE near) OVER (PARTITION BY sheet_id) AS m FROM k),
win AS (SELECT sheet_id, count(*) AS rooms, floor(greatest(0, min(x) - 100)) AS x0, floor(greatest(0, min(y) - 100)) AS y0, floor(least(999, max(x) + 100)) AS x1, floor(least(999, max(y) + 100)) AS y1 FROM e WHERE near OR m < 3 GROUP BY ALL),
wal AS (SELECT site_id AS sheet_id, seq % 7 AS chain, 20.0 + 10 * (seq % 7) AS length, x_ft + 0.5 AS x, y_ft + 0.25 AS y FROM fx_samples),
shr AS (SELECT sheet_id, chain, avg((x BETWEEN x0 - 30 AND x1 + 30 AND y BETWEEN y0 - 30 AND y1 + 30)::INT) AS share, any_value(length) AS length FROM wal JOIN win USING (sheet_id) GROUP BY ALL),
oka AS (SELECT sheet_id, chain FROM shr WHERE share >= 0.35 AND length >= 40 QUALIFY count(*) OVER (PARTITION BY sheet_id) >= 3),
p AS (SELECT DISTINCT sheet_id, x, y FROM wal JOIN oka USING (sheet_id, chain)),{HULL.format(key='sheet_id')},
hld AS (SELECT rom.sheet_id, rom.x, rom.y, count(*) FILTER (WHERE (bx - ax) * (rom.y - ay) - (b_y - ay) * (rom.x - ax) < 0) = 0 AS inside FROM rom JOIN win USING (sheet_id) JOIN hed ON hed.key = rom.sheet_id WHERE rom.x BETWEEN x0 AND x1 AND rom.y BETWEEN y0 AND y1 GROUP BY ALL),
cnt AS (SELECT r.sheet_id, count(*) FILTER (WHERE inside) AS held FROM rom r JOIN hld USING (sheet_id, x, y) GROUP BY ALL),
cor AS (SELECT key AS sheet_id, count(DISTINCT (ax, ay)) AS corners FROM hed GROUP BY ALL)
SELECT p.sheet_id, CAST(CASE WHEN coalesce(any_value(held), 0) >= greatest(2, floor(any_value(rooms) * 0.45)) THEN any_value(corners) END AS INT) AS corners, CAST(floor(min(x)) AS INT) AS x0, CAST(floor(min(y)) AS INT) AS y0, CAST(floor(max(x)) AS INT) AS x1, CAST(floor(max(y)) AS INT) AS y1
FROM p JOIN win USING (sheet_id) JOIN cor USING (sheet_id) LEFT JOIN cnt USING (sheet_id) GROUP BY p.sheet_id""",
    "interior_zones": f"""{with_views('sheets')}, e(ex1, ey1, ex2, ey2) AS (VALUES {EDGES}),
px AS (SELECT x, y, count(*) FILTER (WHERE (ey1 > y) <> (ey2 > y) AND x < (ex2 - ex1) * (y - ey1) / (ey2 - ey1) + ex1) % 2 = 1 AND NOT (x >= 300 AND x < 500 AND y >= 300 AND y < 450) AS free FROM range(1000) a(x), range(900) b(y), e GROUP BY x, y),
t AS (SELECT y // 400 AS ty, x // 480 AS tx, avg(free::INT) AS share, min(x) FILTER (WHERE free) AS x0, max(x) FILTER (WHERE free) AS x1, min(y) FILTER (WHERE free) AS y0, max(y) FILTER (WHERE free) AS y1 FROM px GROUP BY ALL),
z AS (SELECT row_number() OVER (ORDER BY ty, tx) - 1 AS seq, x0, y0, x1, y1 FROM t WHERE share >= 40.0 / 255.0 AND x1 - x0 > 100 AND y1 - y0 > 100)
SELECT sheet_id, seq, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1 FROM fx_sheets, z""",
    "contour_filter": f"""{with_views('points', 'kinds')},{METRICS}, e(ex1, ey1, ex2, ey2) AS (VALUES {EDGES}),
ins AS (SELECT sheet_id, poly_seq, pos, x, y, count(*) FILTER (WHERE (ey1 > y) <> (ey2 > y) AND x < (ex2 - ex1) * (y - ey1) / (ey2 - ey1) + ex1) % 2 = 1 AS inside FROM fx_points, e GROUP BY ALL),
shr AS (SELECT sheet_id, poly_seq, avg((inside AND NOT (x >= 300 AND x < 500 AND y >= 300 AND y < 450))::INT) AS share, avg((x BETWEEN 260 AND 540 AND y BETWEEN 260 AND 490)::INT) AS near FROM ins GROUP BY ALL),
k AS (SELECT m.*, share, near, CASE WHEN poly_seq % 11 = 0 THEN 'property' ELSE kind END AS kind FROM met m JOIN fx_kinds USING (sheet_id, poly_seq) JOIN shr USING (sheet_id, poly_seq)),
s AS (SELECT *, CASE WHEN mean_abs_turn >= 0.12 OR NOT (straightness > 0.92 AND length_px > 120) THEN 'topo_curve' WHEN kind = 'existing' THEN 'contour_dash' WHEN kind = 'property' THEN 'property_dashdot' WHEN kind IN ('building', 'structure') OR straightness > 0.98 THEN 'building_solid' ELSE 'property_dashdot' END AS style FROM k)
SELECT sheet_id, poly_seq, kind NOT IN ('property', 'building', 'structure') AND style NOT IN ('property_dashdot', 'building_solid') AND NOT (sheet_id LIKE '%2' AND style = 'contour_dash')
  AND NOT (mean_abs_turn < 0.08 AND straightness >= 0.93 AND length_px >= 80 AND near > 0.6) AND share >= 0.55 AS keep FROM s""",
    "rejected_styles": f"""{with_views('titles')}, s AS (SELECT sheet_id, list_distinct(list_concat(['property_dashdot', 'building_solid'], list(CASE WHEN regexp_matches(text, 'SIDEWALK|HEAVY') THEN 'hatch' ELSE 'symbol' END) FILTER (WHERE regexp_matches(text, 'SIDEWALK|HEAVY|CURB CUT')))) AS styles FROM fx_titles GROUP BY ALL)
SELECT sheet_id, array_to_string(list_sort(coalesce(styles, ['property_dashdot', 'building_solid'])), ',') AS styles FROM s""",
    "legend_flags": f"{with_views('titles')} SELECT sheet_id, bool_or(contains(upper(text), 'CONTOUR')) AS contour, bool_or(contains(upper(text), 'SILT')) AS silt FROM fx_titles GROUP BY ALL",
    "legend_panel_rows": f"{with_views('titles')},{PANEL} SELECT sheet_id, seq, name FROM row_",
    "legend_entries": f"{with_views('titles')},{ENTRIES} SELECT sheet_id, CAST(seq AS INT) AS seq, e.name AS name, CASE {HINTS.replace('(u,', '(upper(e.name),')} ELSE '{T.OTHER_SYMBOL}' END AS symbol_hint, e.source AS source, e.x AS x0, e.y AS y0 FROM flat",
    "icon_boxes": f"""{with_views('titles')}, b AS (SELECT sheet_id, seq, sheet_id NOT LIKE '%4' AS held, CAST(trunc(greatest(0, x0 - 72 - 8)) AS INT) AS a, CAST(trunc(greatest(0, y0 - 18 * 0.35)) AS INT) AS b, CAST(trunc(least(995, y1 + 18 * 0.35)) AS INT) AS d, x0 FROM fx_titles),
c AS (SELECT *, CAST(trunc(greatest(a + 8, x0 - 4)) AS INT) AS c FROM b), i AS (SELECT sheet_id, seq, CASE WHEN held THEN greatest(a, 300) ELSE a END AS x0, CASE WHEN held THEN greatest(b, 200) ELSE b END AS y0, CASE WHEN held THEN least(c, 990) ELSE c END AS x1, CASE WHEN held THEN least(d, 980) ELSE d END AS y1 FROM c)
SELECT sheet_id, seq, CASE WHEN x1 > x0 + 4 AND y1 > y0 + 4 THEN x0 END AS x0, CASE WHEN x1 > x0 + 4 AND y1 > y0 + 4 THEN y0 END AS y0, CASE WHEN x1 > x0 + 4 AND y1 > y0 + 4 THEN x1 END AS x1, CASE WHEN x1 > x0 + 4 AND y1 > y0 + 4 THEN y1 END AS y1 FROM i""",
    "sheet_headers": f"{with_views('titles')} SELECT sheet_id, " + ", ".join(f"arg_min({c}, struct_pack(a := x0 <= 500, y := y0, s := seq)) FILTER (WHERE {' OR '.join(f'contains(upper(text), {chr(39)}{w}{chr(39)})' for w in words)}) AS {name}_{c}" for name, words in layout.HEADERS.items() for c in ("x0", "y0")) + " FROM fx_titles GROUP BY ALL",
    "column_shares": f"{with_views('pixels')} SELECT sheet_id, x, round(avg((v < {styles.INK})::INT), 6) AS share FROM fx_pixels WHERE x >= 5 AND x < 30 AND y >= 1 AND y < 20 GROUP BY ALL",
    "pixel_profiles": f"""{with_views('points', 'pixels')}, gp AS (SELECT 'G' || (poly_seq % 5) AS sheet_id, poly_seq, pos, x % 43 AS x, y % 31 AS y FROM fx_points),{METRICS.replace('fx_points', 'gp')},
n AS (SELECT sheet_id, poly_seq, n_points, CAST(least(80, greatest(12, floor(round(length_px, 6) / 4))) AS INT) AS n FROM met WHERE n_points >= 2),
s AS (SELECT sheet_id, poly_seq, i AS pos, CAST(floor(i * (n_points - 1)::DOUBLE / greatest(n - 1, 1) + 1e-9) AS INT) AS at_ FROM n, unnest(range(n)) t(i)),
c AS (SELECT s.sheet_id, s.poly_seq, s.pos, CAST(least(39, greatest(0, x)) AS INT) AS px, CAST(least(29, greatest(0, y)) AS INT) AS py FROM s JOIN gp ON s.sheet_id = gp.sheet_id AND s.poly_seq = gp.poly_seq AND s.at_ = gp.pos)
SELECT c.sheet_id, c.poly_seq, CAST(c.pos AS INT) AS pos, round(avg(v), 6) AS gray FROM c JOIN fx_pixels q ON q.sheet_id = c.sheet_id AND q.x BETWEEN px - 1 AND px + 1 AND q.y BETWEEN py - 1 AND py + 1 GROUP BY ALL""",
    "drawing_pixels": f"{with_views('points')} SELECT sheet_id, poly_seq, pos, x >= 100 AND x < 900 AND y >= 50 AND y < 940 AND NOT (x >= 200 AND x < 420 AND y >= 100 AND y < 300) AND NOT (x >= 600 AND x < 800 AND y >= 500 AND y < 980) AS inside FROM fx_points",
    "contour_seeds": f"""{with_views('spans', 'sheets', 'points')},{READ}, px AS (SELECT DISTINCT sheet_id, CAST(x AS INT) AS sx, CAST(y AS INT) AS sy FROM fx_points),
m AS (SELECT e.sheet_id, seq, kind, value_ft AS z, sx, sy, pow(x - sx, 2) + pow(y - sy, 2) AS d2, CASE WHEN kind = 'existing_match' OR e.sheet_id NOT LIKE '%4' THEN 48 ELSE 14 END AS reach FROM parsed e JOIN px USING (sheet_id)),
b AS (SELECT * FROM m WHERE d2 <= reach * reach QUALIFY row_number() OVER (PARTITION BY sheet_id, seq ORDER BY d2, sy, sx) = 1)
SELECT sheet_id, seq, sx, sy, kind, z, round(sqrt(d2), 6) AS distance, row_number() OVER (PARTITION BY sheet_id ORDER BY kind <> 'existing_match', d2, seq) AS rank FROM b""",
    "contour_sources": f"""{with_views('points', 'kinds', 'spans', 'sheets')},{READ},{METRICS}, c AS (SELECT sheet_id, poly_seq % 4 = 0 AS fb, round(length_px, 6) AS l, round(sqrt(dx * dx + dy * dy) / 20, 6) AS gap FROM met),
a AS (SELECT sheet_id, count(*) FILTER (WHERE gap <= 14 AND l > 42) AS closed, count(*) FILTER (WHERE NOT (gap <= 14 AND l > 42)) AS open, avg(l) AS mean_length, count(*) FILTER (WHERE fb) AS fallback FROM c GROUP BY ALL),
h AS (SELECT sheet_id, count(*) AS h FROM parsed WHERE kind <> 'weak' GROUP BY ALL), k AS (SELECT sheet_id, count(*) FILTER (WHERE kind = 'existing') AS e, count(*) FILTER (WHERE kind = 'proposed') AS p, count(*) FILTER (WHERE kind = 'topo') AS s, count(*) FILTER (WHERE kind = 'structure') AS r FROM fx_kinds GROUP BY ALL)
SELECT sheet_id, coalesce(h, 0) AS seeds_hit, closed, open, round(mean_length, 6) AS mean_length, fallback,
  format('existing={{}}, proposed={{}}; seeded={{}}/{{}}, closed={{}}, open={{}}, mean_len={{}}px, fallback={{}}, style_drop={{}}', e, p, coalesce(h, 0), coalesce(h, 0) + 1, closed, open, CAST(round_even(mean_length, 0) AS BIGINT), fallback, s) AS existing_vs_proposed, CAST(1 + (s + r > 0)::INT AS INT) AS notes
FROM a LEFT JOIN h USING (sheet_id) JOIN k USING (sheet_id)""",
    "seed_kinds": f"{with_views('spans', 'sheets', 'kinds')},{READ} SELECT p.sheet_id, p.seq, CASE WHEN k.kind = 'proposed' AND p.kind = 'existing_match' AND abs(value_ft - round(value_ft)) < 1e-6 THEN 'existing' ELSE k.kind END AS kind FROM parsed p JOIN fx_kinds k ON p.sheet_id = k.sheet_id AND p.seq = k.poly_seq",
    "line_parts": f"{with_views('segments')}, a AS (SELECT sheet_id, seq * 37 % 4001 AS area FROM fx_segments), b AS (SELECT sheet_id, false AS seeded, area FROM a WHERE area BETWEEN 40 AND 2400 UNION ALL SELECT sheet_id, true, area FROM a WHERE area >= 22) SELECT sheet_id, seeded, count(*) AS parts, CAST(sum(area) AS BIGINT) AS area FROM b GROUP BY ALL",
    "hex_colors": f"{with_views('segments')}, c AS (SELECT sheet_id, seq, seq * 7919 % 16777216 AS v FROM fx_segments) SELECT sheet_id, seq, CAST(v % 256 AS INT) AS blue, CAST(v // 256 % 256 AS INT) AS green, CAST(v // 65536 AS INT) AS red FROM c",
    "display_scales": f"{with_views('segments')} SELECT sheet_id, seq, round(least(1.0::DOUBLE, 1600 / seq::DOUBLE), 6) AS scale FROM fx_segments",
    "lifted_frames": f"{with_views('segments')} SELECT sheet_id, seq, CASE WHEN seq % 3 <> 0 THEN x1 + 30 END AS x0, CASE WHEN seq % 3 <> 0 THEN y1 + 40 END AS y0, CASE WHEN seq % 3 <> 0 THEN x2 + 30 END AS x1, CASE WHEN seq % 3 <> 0 THEN y2 + 40 END AS y1, x1 + 30 AS px, y1 + 40 AS py, x2 AS bx, y2 AS by FROM fx_segments",
    "region_totals": f"{with_views('truth')} SELECT site_id AS job, cut_cy, fill_cy, CASE WHEN site_id NOT LIKE '%5' THEN round(cut_cy / 2 + cut_cy / 4, 6) END AS regions_cut_cy, CASE WHEN site_id NOT LIKE '%5' THEN round(fill_cy / 3 + fill_cy / 5, 6) END AS regions_fill_cy, CASE WHEN site_id NOT LIKE '%5' THEN 2 ELSE 0 END::BIGINT AS regions FROM fx_truth",
    "callout_surfaces": f"{READINGS} SELECT sheet_id, seq, CASE WHEN kind = 'existing_match' THEN 'existing' WHEN kind IN ('ffe', 'spot', 'weak') THEN 'proposed' END AS alone, CASE WHEN kind = 'existing_match' THEN 'existing' ELSE 'proposed' END AS fused FROM parsed",
    "final_kinds": f"{with_views('kinds', 'sheets')} SELECT sheet_id, poly_seq, CASE WHEN kind IN ('structure', 'property', 'building') THEN NULL WHEN kind IN ('existing', 'proposed') THEN kind WHEN role = 'existing' THEN 'existing' ELSE 'proposed' END AS kind FROM fx_kinds JOIN fx_sheets USING (sheet_id)",
    "refined_templates": f"""{with_views('ink')},{PROFILE}, t(place, name, sig, il, ih, tl, th, g) AS (VALUES {', '.join(str((i, *t)) for i, t in enumerate(styles.TEMPLATES))}),
s AS (SELECT CASE stroke_id WHEN 3 THEN 'existing_contour' ELSE 'property_line' END AS name, pattern, ink_ratio AS i, trans_rate AS r, mean_gray AS m FROM prof WHERE stroke_id IN (3, 8))
SELECT place, name, coalesce(pattern, sig) AS dash_signature, round(coalesce(greatest(0.05, least(il, i - 0.2)), il), 6)::DOUBLE AS ink_lo, round(coalesce(least(1.0, greatest(ih, i + 0.2)), ih), 6)::DOUBLE AS ink_hi, round(coalesce(greatest(0.0, least(tl, r - 0.1)), tl), 6)::DOUBLE AS tr_lo,
  round(coalesce(least(0.8, greatest(th, r + 0.15)), th), 6)::DOUBLE AS tr_hi, round(CASE WHEN i IS NULL THEN g ELSE greatest(g, m + 35) END, 6)::DOUBLE AS gray_max FROM t LEFT JOIN s USING (name)""",
    "fallback_samples": f"""{with_views('samples')}, f AS (SELECT * FROM fx_samples WHERE surface = 'existing' OR site_id NOT LIKE '%3' OR seq % 3000 = 1), few AS (SELECT site_id FROM fx_samples GROUP BY ALL HAVING site_id NOT IN (SELECT site_id FROM f WHERE surface = 'proposed' GROUP BY site_id HAVING count(*) >= 3)),
u AS (SELECT site_id, surface, z FROM f WHERE surface = 'existing' OR site_id NOT IN (SELECT site_id FROM few) UNION ALL SELECT site_id, 'proposed', z + 1 FROM fx_samples WHERE site_id IN (SELECT site_id FROM few)) SELECT site_id, surface, count(*) AS n, round(sum(z), 6) AS z FROM u GROUP BY ALL""",
    "sheet_samples": f"{with_views('spans', 'sheets', 'points', 'kinds')},{READ},{FOUND} SELECT sheet_id, surface, count(*) AS n, round(sum(x), 6) AS x, round(sum(y), 6) AS y, round(sum(z), 6) AS z FROM smp WHERE surface IS NOT NULL GROUP BY ALL",
    "site_feet": f"{with_views('samples', 'sheets')},{FRAMES} SELECT fr.site_id, surface, seq, round((x_ft - ox) * ft, 6) AS x_ft, round((y_ft - oy) * ft, 6) AS y_ft, z FROM fx_samples s JOIN fr ON s.site_id = fr.sheet_id",
    "site_frames": f"{with_views('sheets')},{FRAMES} SELECT site_id, round(w * ft, 6) AS w, round(h * ft, 6) AS h FROM fr",
    "fused_statuses": f"{with_views('samples', 'frames', 'truth')},{FUSED}, n AS (SELECT site_id, count(*) FILTER (WHERE surface = 'existing') AS e, count(*) FILTER (WHERE surface = 'proposed') AS p FROM fused GROUP BY ALL) SELECT site_id, CASE WHEN fill_cy > 0 THEN 'fused' ELSE 'failed' END AS cut_fill, 'fused existing_pts=' || coalesce(e, 0) || ', proposed_pts=' || coalesce(p, 0) AS existing_vs_proposed, CAST(1 + (coalesce(e, 0) < 3)::INT AS INT) AS warnings FROM fx_truth LEFT JOIN n USING (site_id)",
    "dash_patterns": f"""{with_views('segments', 'pixels')},{ALONG.format(n='greatest(50, floor(len / 1.2))')},{RUNS}, al2 AS (SELECT sheet_id, seq, CAST(sum(size) AS BIGINT) AS places, sum(size) FILTER (WHERE ink) / sum(size) AS ink_ratio FROM ru GROUP BY ALL),
inn AS (SELECT * FROM ru QUALIFY ink OR (run > min(run) OVER (PARTITION BY sheet_id, seq) AND run < max(run) OVER (PARTITION BY sheet_id, seq))),
st AS (SELECT sheet_id, seq, count(*) FILTER (WHERE ink) AS inks, count(*) FILTER (WHERE NOT ink) AS gaps, quantile_cont(size, 0.25) FILTER (WHERE ink) AS low, stddev_pop(size) FILTER (WHERE ink) / greatest(avg(size) FILTER (WHERE ink), 1.0) AS spread, avg(size) FILTER (WHERE NOT ink) AS gap_mean FROM inn GROUP BY ALL),
sd AS (SELECT sheet_id, seq, count(*) FILTER (WHERE size / low >= 2.8) AS longs, count(*) FILTER (WHERE size / low <= 1.7) AS shorts, median(size) FILTER (WHERE size / low >= 2.8) / greatest(median(size) FILTER (WHERE size / low <= 1.7), 1.0) AS ratio FROM inn JOIN st USING (sheet_id, seq) WHERE ink GROUP BY ALL)
SELECT sheet_id, seq, places, round(coalesce(ink_ratio, 0), 6) AS ink_ratio, inks, gaps, coalesce(longs, 0) AS longs, coalesce(shorts, 0) AS shorts, round(CASE WHEN longs > 0 THEN ratio END, 6) AS ratio, round(spread, 6) AS spread, round(gap_mean, 6) AS gap_mean,
  coalesce(places >= 40 AND inks >= 3 AND gaps >= 2 AND longs >= 1 AND shorts >= 2 AND spread >= 0.35 AND ratio BETWEEN 2.6 AND 6.5 AND ink_ratio BETWEEN 0.25 AND 0.82, false) AS long_short FROM al2 JOIN st USING (sheet_id, seq) LEFT JOIN sd USING (sheet_id, seq)""",
    "wall_strokes": f"""{with_views('segments', 'pixels')},{ALONG.format(n='greatest(50, floor(len / 1.5))')},{RUNS}, rr AS (SELECT sheet_id, seq, coalesce(sum(size) FILTER (WHERE ink), 0) / sum(size) AS ink_ratio, coalesce(max(size) FILTER (WHERE ink), 0) / sum(size) AS longest FROM ru GROUP BY ALL),
p4 AS (SELECT m.sheet_id, seq, len, a0 - 180 * floor(a0 / 180) AS ang, CAST(trunc(greatest(0.0, least(39.0, x1 + i * (x2 - x1) / 39))) AS INT) AS px, CAST(trunc(greatest(0.0, least(29.0, y1 + i * (y2 - y1) / 39))) AS INT) AS py FROM m, range(40) t(i)),
gr AS (SELECT p4.sheet_id, seq, any_value(len) AS len, any_value(least(ang, 180 - ang, abs(ang - 90))) AS axis, avg(v) AS mean_gray FROM p4 LEFT JOIN fx_pixels q ON q.sheet_id = p4.sheet_id AND x = px AND y = py GROUP BY p4.sheet_id, seq)
SELECT sheet_id, seq, round(ink_ratio, 6) AS ink_ratio, round(longest, 6) AS longest, round(mean_gray, 6) AS mean_gray, round(axis, 6) AS axis, len >= 140 AND axis <= 10 AND ink_ratio >= 0.88 AND mean_gray <= 90 AND longest >= 0.75 AS wall FROM rr JOIN gr USING (sheet_id, seq)""",
    "page_crops": f"{with_views('pixels')} SELECT sheet_id, y - 1 AS y, string_agg(printf('%02x', v), '' ORDER BY x) AS gray FROM fx_pixels WHERE x >= 3 AND x < 11 AND y >= 1 AND y < 7 GROUP BY ALL",
    "truth_reports": f"{with_views('truth')} SELECT site_id AS job, cut_cy, fill_cy, CAST(NULL AS VARCHAR) AS notes, cut_cy / 2 AS pad_cut, 505.0::DOUBLE AS stripping_cy, CAST(NULL AS DOUBLE) AS sectional_cy FROM fx_truth",
    "swatch_patterns": f"""{with_views('pixels')}, sz AS (SELECT sheet_id, min(x) AS nx, max(x) AS mx, min(y) AS ny, max(y) AS my, min(x) FILTER (WHERE v < 210) AS lx, max(x) FILTER (WHERE v < 210) AS hx, min(y) FILTER (WHERE v < 210) AS ly, max(y) FILTER (WHERE v < 210) AS hy FROM fx_pixels GROUP BY ALL),
bx AS (SELECT sheet_id, greatest(nx, lx - 2) AS x0, least(mx, hx + 2) AS x1, greatest(ny, ly - 2) AS y0, least(my, hy + 2) - greatest(ny, ly - 2) + 1 AS h FROM sz WHERE lx IS NOT NULL),
cl AS (SELECT sheet_id, x - x0 AS pos, avg(v) AS gray FROM fx_pixels JOIN bx USING (sheet_id) WHERE h >= 4 AND x1 - x0 >= 7 AND x BETWEEN x0 AND x1 AND y - y0 BETWEEN floor(h * 0.35) AND floor(h * 0.65) GROUP BY ALL),
fa AS (SELECT *, avg((gray < 200)::INT) OVER (PARTITION BY sheet_id) < 0.05 AS faint FROM cl), inked AS (SELECT sheet_id AS stroke_id, pos, gray, gray < CASE WHEN faint THEN 220 ELSE 200 END AS ink FROM fa),{PROFILE.replace('fx_ink', 'inked')}
SELECT stroke_id AS sheet_id, pattern, round(ink_ratio, 6) AS ink_ratio, round(trans_rate, 6) AS trans_rate, round(mean_gray, 6) AS mean_gray FROM prof WHERE ink_ratio > 0""",
    "site_regions": f"""{with_views('sheets')}, r AS (SELECT sheet_id, unnest([struct_pack(seq := 0, name := 'drawing', x0 := 0, y1 := 1000, color := '#3B82F6', role := 'drawing'), struct_pack(seq := 2, name := 'legend', x0 := 300, y1 := 980, color := '#A855F7', role := 'chrome'),
  struct_pack(seq := 101, name := 'building', x0 := 300, y1 := 450, color := '#F97316', role := 'site'), struct_pack(seq := 200, name := 'topo_zone_1', x0 := 0, y1 := 3, color := '#86EFAC', role := 'topo_zone'), struct_pack(seq := 201, name := 'topo_zone_2', x0 := 7, y1 := 10, color := '#86EFAC', role := 'topo_zone')]) AS r FROM fx_sheets
  UNION ALL SELECT sheet_id, struct_pack(seq := 1, name := 'notes', x0 := 300, y1 := 980, color := '#F59E0B', role := 'chrome') FROM fx_sheets WHERE sheet_id LIKE '%1' UNION ALL SELECT sheet_id, struct_pack(seq := 100, name := 'property', x0 := 300, y1 := 450, color := '#EF4444', role := 'site') FROM fx_sheets WHERE sheet_id LIKE '%2')
SELECT sheet_id, r.seq AS seq, r.name AS name, r.x0 AS x0, r.y1 AS y1, r.color AS color, r.role AS role FROM r""",
    "site_outlines": rf"""{with_views('dashes', 'spans')},{DRAWN},
sh AS (SELECT DISTINCT 'S' || (seq % 5) AS sheet_id FROM fx_spans),
ln AS (SELECT k.sheet_id, k.chain, k.wall, k.length, min(g.x1) AS x1, min(g.y1) AS y1, max(g.x2) AS x2, max(g.y2) AS y2 FROM k JOIN g ON g.sheet_id = k.sheet_id AND (g.w > 1.4) = k.wall AND g.nr // 12 * 12 = k.chain WHERE k.rank <= CASE WHEN k.wall THEN 50 ELSE 28 END GROUP BY ALL),
dn AS (SELECT *, CAST(greatest(8, floor(length / 10)) AS INT) AS n FROM ln), dp AS (SELECT sheet_id, chain, wall, length, x1 + i * (x2 - x1) / (n - 1) - 20 AS x, y1 + i * (y2 - y1) / (n - 1) - 30 AS y FROM dn, unnest(range(n)) t(i)),
rom AS (SELECT 'S' || (seq % 5) AS sheet_id, x - 20 AS x, y - 30 AS y FROM fx_spans WHERE regexp_full_match(text, '\d{{3}}') AND x BETWEEN 20 AND 960 AND y BETWEEN 30 AND 900), c AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy, count(*) OVER w AS n FROM rom WINDOW w AS (PARTITION BY sheet_id)),
d AS (SELECT *, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM c WHERE n >= 3), kk AS (SELECT *, d <= greatest(180, 2.6 * median(d) OVER (PARTITION BY sheet_id)) AS near FROM d), e AS (SELECT *, count(*) FILTER (WHERE near) OVER (PARTITION BY sheet_id) AS m FROM kk),
win AS (SELECT sheet_id, count(*) AS rooms, floor(greatest(0, min(x) - 100)) AS x0, floor(greatest(0, min(y) - 100)) AS y0, floor(least(939, max(x) + 100)) AS x1, floor(least(869, max(y) + 100)) AS y1 FROM e WHERE near OR m < 3 GROUP BY ALL),
shr AS (SELECT sheet_id, chain, avg((x BETWEEN x0 - 30 AND x1 + 30 AND y BETWEEN y0 - 30 AND y1 + 30)::INT) AS share, any_value(length) AS length FROM dp JOIN win USING (sheet_id) WHERE wall AND sheet_id <> 'S3' GROUP BY ALL),
oka AS (SELECT sheet_id, chain FROM shr WHERE share >= 0.35 AND length >= 40 QUALIFY count(*) OVER (PARTITION BY sheet_id) >= 3),
p AS (SELECT DISTINCT sheet_id || wall::VARCHAR AS sheet_id, x, y FROM dp WHERE NOT wall UNION SELECT DISTINCT sheet_id || 'true', x, y FROM dp JOIN oka USING (sheet_id, chain) WHERE wall),
q AS (SELECT sheet_id, x, min(y) AS y FROM p GROUP BY ALL UNION SELECT sheet_id, x, max(y) FROM p GROUP BY ALL),{HULL.format(key='sheet_id').replace('FROM p ', 'FROM q ').replace('JOIN p ', 'JOIN q ')},
hld AS (SELECT rom.sheet_id, rom.x, rom.y, count(*) FILTER (WHERE (bx - ax) * (rom.y - ay) - (b_y - ay) * (rom.x - ax) < 0) = 0 AS inside FROM rom JOIN win USING (sheet_id) JOIN hed ON hed.key = rom.sheet_id || 'true' WHERE rom.x BETWEEN x0 AND x1 AND rom.y BETWEEN y0 AND y1 GROUP BY ALL),
cnt AS (SELECT r.sheet_id, count(*) FILTER (WHERE inside) AS held FROM rom r JOIN hld USING (sheet_id, x, y) GROUP BY ALL),
pro AS (SELECT sheet_id, count(DISTINCT chain) AS n, CAST(floor(min(x)) + 20 AS INT) AS px0, CAST(floor(min(y)) + 30 AS INT) AS py0, CAST(floor(max(x)) + 20 AS INT) AS px1, CAST(floor(max(y)) + 30 AS INT) AS py1 FROM dp WHERE NOT wall GROUP BY ALL),
cor AS (SELECT key, count(DISTINCT (ax, ay)) AS corners FROM hed GROUP BY ALL),
bld AS (SELECT sheet_id, CAST(floor(min(x)) + 20 AS INT) AS bx0, CAST(floor(min(y)) + 30 AS INT) AS by0, CAST(floor(max(x)) + 20 AS INT) AS bx1, CAST(floor(max(y)) + 30 AS INT) AS by1 FROM dp JOIN oka USING (sheet_id, chain) WHERE wall GROUP BY ALL),
wls AS (SELECT sheet_id, count(DISTINCT chain) AS n FROM dp WHERE wall AND sheet_id <> 'S3' GROUP BY ALL)
SELECT sh.sheet_id, CAST(CASE WHEN pro.n >= 3 AND corners >= 3 THEN corners END AS INT) AS corners, px0, py0, px1, py1, bx0 IS NOT NULL AND coalesce(held, 0) >= greatest(2, floor(rooms * 0.45)) AS built, bx0, by0, bx1, by1, coalesce(pro.n, 0) AS n_property, coalesce(wls.n, 0) AS n_building,
  'property=' || CASE WHEN pro.n > 0 THEN 'pdf' ELSE 'miss' END || '(n=' || coalesce(pro.n, 0) || '); building=' || CASE WHEN wls.n > 0 THEN 'pdf' WHEN sh.sheet_id = 'S3' THEN 'skip' ELSE 'miss' END || '(n=' || coalesce(wls.n, 0) || '); role=' || CASE WHEN sh.sheet_id = 'S3' THEN 'existing' ELSE 'proposed' END AS notes
FROM sh LEFT JOIN pro USING (sheet_id) LEFT JOIN cor ON cor.key = sh.sheet_id || 'false' LEFT JOIN bld USING (sheet_id) LEFT JOIN win USING (sheet_id) LEFT JOIN cnt USING (sheet_id) LEFT JOIN wls USING (sheet_id)""",
}
assert "elevations_clean" not in BASE  # its SQL stands here, beside that of its greedy step
