"""Sheet layout from text: the drawing, and the panels of the rail to its right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracut.functions.geometry import clamp_bbox
from terracut.functions.text import holds_any, stripped
from terracut.operators.raster import column_ink
from terracut.sources.scratch import kept

# Words of panel headers, of legend entries, and of what ends a legend.
HEADERS = {
    "map_legend": ["MAP LEGEND"],
    "any_legend": ["MAP LEGEND", "LEGEND"],
    "notes": ["GENERAL NOTES", "DEMOLITION KEYNOTES", "GRADING KEYNOTES"],
    "title": ["SHEET TITLE", "GRADING PLAN", "EXISTING CONDITIONS", "SITE PLAN"],
    "scale": ["SCALE", '1"', "GRAPHIC SCALE"],
}
ENTRY_LABELS = ["BUILDING LINE", "PROPERTY LINE", "EXISTING CONTOUR", "PROPOSED CONTOUR", "TOP OF CURB", "MATCH EXISTING", "DRAINAGE FLOW", "SLOPE GRADE", "CONCRETE SIDEWALK", "HEAVY-DUTY CONCRETE", "HEAVY DUTY CONCRETE", "PROPOSED BUILDING", "CURB CUT", "RIP RAP", "SPOT ELEVATION"]
STOPPERS = ["CURB & GUTTER", "CURB AND GUTTER", "SHEET TITLE", "GRADING PLAN", "EXISTING CONDITIONS", "REVISION", "DEMOLITION KEYNOTES", "GENERAL NOTES", "GRADING KEYNOTES"]
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
COLORS = {"drawing": "#3B82F6", "notes": "#F59E0B", "legend": "#A855F7", "title_block": "#EAB308", "scale": "#10B981"}


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def headers(spans: DataFrame, sheets: DataFrame) -> DataFrame:
    """sheet_id and one box for each kind of header: the topmost hit in the right half, else the topmost. One pass over the spans."""
    s = spans.join(sheets.select("sheet_id", "width_px"), "sheet_id").withColumn("t", F.upper(stripped(F.col("text"))))
    place = F.struct((F.col("bbox_px.x0") <= F.col("width_px") * 0.5).alias("left"), F.col("bbox_px.y0").alias("y"), "seq")
    return s.groupBy("sheet_id").agg(*[F.min_by("bbox_px", F.when(holds_any(F.col("t"), words), place)).alias(name) for name, words in HEADERS.items()])


# Gray below which swatches and panel rules are ink, shares of a column's pixels that make it one of either, and pixels searched for a rule.
SWATCH_INK, SWATCH_SHARE, RULE_INK, RULE_SHARE, RULE_REACH = 185, 0.012, 140, 0.35, 50


def swatch_edges(bands: DataFrame, gray_rows: DataFrame) -> DataFrame:
    """sheet_id, symbol_left, frame_left: how far swatches and the panel's rule reach to the left of a legend's labels.

    bands: sheet_id, w, head_x0, label_left, y0, y1, reach. gray_rows: sheet_id, y, gray. Swatches count if ink stands near the labels; then the
    leftmost column with ink is their edge, as dashes leave columns empty. Sheets without rows are as those without ink.
    """

    def columns(b: DataFrame, right: Column, reach: Column, below: int, share: float) -> DataFrame:
        """b with x0, x1 (half open columns searched, at most reach) and hits: leftmost and rightmost column with enough ink."""
        b = b.withColumn("x1", F.floor(F.greatest(F.lit(1), F.least(F.col("w") - 1, right))).cast("int"))
        b = b.withColumn("x0", F.greatest(F.lit(0), F.col("x1") - reach).cast("int"))
        boxes = b.select("sheet_id", box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("box"))
        ink = column_ink(gray_rows, boxes, below).where(F.col("share") > share).groupBy("sheet_id").agg(F.min("x").alias("first"), F.max("x").alias("last"))
        return b.join(ink, "sheet_id", "left")

    b = columns(bands, F.col("label_left") - 2, F.col("reach"), SWATCH_INK, SWATCH_SHARE)
    wide = F.col("x1") - F.col("x0")
    attached = (F.col("y1") > F.col("y0") + 2) & (wide > 2) & (F.col("last") >= F.col("x1") - F.greatest(F.lit(12), F.floor(wide / 8)))
    symbol = F.when(attached, F.col("first") - 8).otherwise(F.floor(F.col("label_left") - F.col("reach") * 0.85))
    b = b.withColumn("symbol_left", F.floor(F.greatest(symbol, F.col("head_x0") - 220, F.col("w") * 0.62)).cast("int"))
    # One row for each sheet: written, so that the second search reads values.
    b = kept(b.select("sheet_id", "w", "head_x0", "y0", "y1", "symbol_left"), "swatch-edges")
    b = columns(b, F.col("symbol_left"), F.lit(RULE_REACH), RULE_INK, RULE_SHARE)
    ruled = (F.col("y1") > F.col("y0") + 4) & (F.col("x1") - F.col("x0") > 2) & F.col("first").isNotNull()
    frame = F.when(ruled, F.col("first")).otherwise(F.col("symbol_left") - 20)
    return b.select("sheet_id", "symbol_left", F.floor(F.greatest(frame, F.col("w") * 0.60, F.col("head_x0") - 260)).cast("int").alias("frame_left"))


def legend_panels(spans: DataFrame, sheets: DataFrame, heads: DataFrame, gray_rows: DataFrame | None = None) -> DataFrame:
    """sheet_id, legend: the box around legend header, swatch column and labels; null without a header. By text alone, or with the ink of gray_rows."""
    h, w = F.col("height_px"), F.col("width_px")
    head = F.col("head")
    b = heads.select("sheet_id", F.coalesce("map_legend", "any_legend").alias("head"), F.col("title").alias("title_head")).where("head IS NOT NULL").join(sheets.select("sheet_id", "width_px", "height_px"), "sheet_id")
    s = b.join(spans.select("sheet_id", "text", F.col("bbox_px").alias("p")), "sheet_id", "left").withColumn("t", F.regexp_replace(F.upper(stripped(F.col("text"))), r"\s+", " "))
    p = F.col("p")
    in_rail = (p["y0"] >= head["y1"] - 2) & (p["x0"] >= F.greatest(w * 0.58, head["x0"] - 120))
    entry = in_rail & holds_any(F.col("t"), ENTRY_LABELS)
    column = in_rail & (p["x0"] <= head["x1"] + 280) & (p["y0"] <= head["y1"] + F.floor(h * 0.45))
    stop = (p["y0"] > head["y1"] + 80) & (p["x0"] >= w * 0.5) & holds_any(F.col("t"), STOPPERS)
    pick = lambda f, cond, v, name: f(F.when(cond, p[v])).alias(name)
    a = s.groupBy("sheet_id", "head", "title_head", "width_px", "height_px").agg(
        pick(F.min, entry, "x0", "ex0"), pick(F.max, entry, "x1", "ex1"), pick(F.min, entry, "y0", "ey0"), pick(F.max, entry, "y1", "ey1"),
        pick(F.min, column, "x0", "cx0"), pick(F.max, column, "x1", "cx1"), pick(F.max, column, "y1", "cy1"), F.min(F.when(stop, F.floor(p["y0"] - 10))).alias("stop"),
    )
    keyed = F.col("ex0").isNotNull()
    left = F.when(keyed, F.least("ex0", F.coalesce("cx0", "ex0"))).otherwise(F.coalesce("cx0", head["x0"]))
    right = F.when(keyed, F.col("ex1")).otherwise(F.coalesce("cx1", F.greatest(head["x1"], head["x0"] + 200)))
    top = F.when(keyed, F.least(head["y0"] - 8, F.col("ey0") - 8)).otherwise(head["y0"] - 8)
    bottom = F.when(keyed, F.greatest(F.col("ey1") + 40, F.coalesce(F.col("cy1") + 28, F.col("ey1") + 40))).otherwise(F.coalesce(F.col("cy1") + 28, head["y1"] + F.floor(h * 0.28)))
    below_title = F.when(F.col("title_head.y0") > head["y1"] + 80, F.floor(F.col("title_head.y0") - 10))
    bottom = F.least(bottom, F.coalesce(F.least("stop", below_title), bottom))
    # Without pixels the swatch column is as wide as a search for its ink would have reached.
    reach = F.greatest(F.lit(120.0), F.least(F.least(F.lit(280.0), F.greatest(F.lit(120.0), head["x0"] - w * 0.68)), w * 0.07))
    swatch = F.greatest(left - reach, head["x0"] - 220, w * 0.62)
    x0 = F.greatest(F.floor(F.least(F.greatest(swatch, w * 0.60, head["x0"] - 260), swatch) - 10), w * 0.58)
    if gray_rows is not None:
        whole = lambda c: F.floor(c).cast("int")
        bands = a.select("sheet_id", w.alias("w"), head["x0"].alias("head_x0"), left.alias("label_left"), whole(F.greatest(F.lit(0.0), top)).alias("y0"), whole(F.least(h, bottom)).alias("y1"), whole(reach).alias("reach"))
        a = a.join(swatch_edges(kept(bands, "legend-bands"), gray_rows), "sheet_id")
        x0 = F.greatest(F.least("frame_left", "symbol_left") - 10, F.floor(w * 0.58))
    panel = box(x0, F.greatest(F.lit(0.0), F.least(top, head["y0"] - 24)), F.least(w, F.greatest(right, head["x1"]) + 40), F.least(h, F.greatest(bottom, head["y1"] + 80)))
    return a.select("sheet_id", clamp_bbox(panel, w, h).alias("legend"))


def fallback_split(spans: DataFrame, sheets: DataFrame) -> DataFrame:
    """sheet_id, fallback: the rail's left edge where no header shows it: the tenth-percent smallest left edge of right-hand texts."""
    s = spans.join(sheets.select("sheet_id", "width_px"), "sheet_id").where((F.col("bbox_px.x0") + F.col("bbox_px.x1")) / 2 > F.col("width_px") * 0.55)
    lefts = s.groupBy("sheet_id").agg(F.array_sort(F.collect_list("bbox_px.x0")).alias("lefts"))
    w = F.col("width_px")
    pick = F.element_at("lefts", (F.floor(F.size("lefts") / 10) + 1).cast("int"))
    edge = F.floor(F.greatest(w * 0.55, F.least(F.floor(pick - 12), w * 0.80)))
    return sheets.select("sheet_id", "width_px").join(lefts, "sheet_id", "left").select("sheet_id", F.when(F.col("lefts").isNull(), F.floor(w * 0.70)).otherwise(edge).alias("fallback"))


def layouts(spans: DataFrame, sheets: DataFrame, gray_rows: DataFrame | None = None) -> DataFrame:
    """sheet_id, split, drawing_bbox, legend_bbox, notes_bbox, title_bbox, scale_bbox, chrome_bboxes, notes of every sheet.

    spans: sheet_id, seq, text, bbox_px (BOX). sheets: sheet_id, width_px, height_px. gray_rows: the pages' pixels, if there are any.
    """
    heads = kept(headers(spans, sheets), "headers")
    t = sheets.select("sheet_id", F.col("width_px").cast("double").alias("w"), F.col("height_px").cast("double").alias("h")).join(heads, "sheet_id", "left").join(legend_panels(spans, sheets, heads, gray_rows), "sheet_id", "left").join(fallback_split(spans, sheets), "sheet_id")
    w, h, legend = F.col("w"), F.col("h"), F.col("legend")
    lhead = F.coalesce("map_legend", "any_legend")
    edge = lambda head: F.when(head["x0"] > w * 0.55, F.floor(head["x0"] - 200))
    left = F.array_min(F.array_compact(F.array(legend["x0"].cast("double"), edge(F.col("notes")).cast("double"), edge(F.col("title")).cast("double"), edge(lhead).cast("double"))))
    split = F.when(left.isNull(), F.col("fallback")).otherwise(F.floor(F.greatest(w * 0.62, F.least(left, w * 0.82))))
    t = t.withColumn("split", split.cast("int"))
    ys = F.array_sort(F.array_compact(F.array(F.struct(F.col("notes.y0").alias("y"), F.lit(0).alias("k")), F.struct(lhead["y0"].alias("y"), F.lit(1).alias("k")), F.struct(F.col("title.y0").alias("y"), F.lit(2).alias("k")))))
    # One row for each sheet: written, so that what follows reads values and not the rules that made them.
    t = kept(t.withColumn("ys", F.filter(ys, lambda p: p["y"].isNotNull())), "splits")

    def panel(head: Column, k: int) -> Column:
        after = F.filter("ys", lambda p: (p["y"] > head["y0"]) | ((p["y"] == head["y0"]) & (p["k"] > k)))
        y0 = F.floor(F.greatest(F.lit(0.0), head["y0"] - 10))
        y1 = F.coalesce(F.floor(F.try_element_at(after, F.lit(1))["y"] - 6), h)
        if k == 0:
            y1 = F.when(legend["y0"] > y0, F.least(y1, legend["y0"] - 4)).otherwise(y1)
        return F.when(head["y0"].isNotNull(), clamp_bbox(box(F.col("split"), y0, w, F.greatest(y1, y0 + 48)), w.cast("int"), h.cast("int")))

    t = t.withColumn("notes_bbox", panel(F.col("notes"), 0)).withColumn("title_bbox", F.coalesce(panel(F.col("title"), 2), clamp_bbox(box(F.col("split"), F.floor(h * 0.62), w, h), w.cast("int"), h.cast("int"))))
    snapped = clamp_bbox(box(F.least(legend["x0"], F.col("split")), legend["y0"], w, F.greatest(F.least(legend["y1"], F.col("title_bbox.y0") - 4), legend["y0"] + 48)), w.cast("int"), h.cast("int"))
    sc = F.col("scale")
    scale = clamp_bbox(box(F.floor(F.greatest(F.col("split"), sc["x0"] - 40)), F.floor(sc["y0"] - 20), F.floor(F.least(w, sc["x1"] + 220)), F.floor(sc["y1"] + 40)), w.cast("int"), h.cast("int"))
    t = t.withColumn("legend_bbox", F.when(legend.isNotNull(), snapped)).withColumn("scale_bbox", F.when(sc.isNotNull(), scale)).withColumn("drawing_bbox", clamp_bbox(box(F.lit(0), F.lit(0), F.col("split"), h), w.cast("int"), h.cast("int")))
    note = F.concat(F.lit("right rail @ x="), F.col("split").cast("string"), F.lit("; legend="), F.when(legend.isNotNull(), "full").otherwise("miss"))
    return t.select("sheet_id", "split", "drawing_bbox", "legend_bbox", "notes_bbox", "title_bbox", "scale_bbox", F.array_compact(F.array("legend_bbox", "notes_bbox", "title_bbox", "scale_bbox")).alias("chrome_bboxes"), note.alias("notes"))


def regions(layout: DataFrame) -> DataFrame:
    """sheet_id, seq, name, bbox, color, role: one row for each panel of a sheet, drawing first."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("seq"), F.lit(name).alias("name"), F.col(column).alias("bbox"), F.lit(COLORS[name]).alias("color"), F.lit(role).alias("role"))
        for i, (name, column, role) in enumerate([("drawing", "drawing_bbox", "drawing"), ("notes", "notes_bbox", "chrome"), ("legend", "legend_bbox", "chrome"), ("title_block", "title_bbox", "chrome"), ("scale", "scale_bbox", "metadata")])
    ])
    return layout.select("sheet_id", F.explode(F.filter(rows, lambda r: r["bbox"].isNotNull())).alias("r")).select("sheet_id", "r.*")


def with_site(regions_: DataFrame, site: DataFrame, zones: DataFrame) -> DataFrame:
    """regions() rows plus property, building and zones (sheet_id, seq, bbox) of the site (sheet_id, property_bbox, building_bbox)."""
    parts = regions_
    for k, (name, color) in enumerate((("property", "#EF4444"), ("building", "#F97316"))):
        parts = parts.unionByName(site.where(f"{name}_bbox IS NOT NULL").select("sheet_id", F.lit(100 + k).alias("seq"), F.lit(name).alias("name"), F.col(f"{name}_bbox").alias("bbox"), F.lit(color).alias("color"), F.lit("site").alias("role")))
    return parts.unionByName(zones.select("sheet_id", (F.col("seq") + 200).cast("int").alias("seq"), F.concat(F.lit("topo_zone_"), F.col("seq") + 1).alias("name"), "bbox", F.lit("#86EFAC").alias("color"), F.lit("topo_zone").alias("role")))
