"""Legend entries from the texts of the legend panel, and known labels found elsewhere on the sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.functions import text as T
from terracut.functions.geometry import bbox_center, in_bbox

ENTRY = "struct<name: string, bbox: struct<x0: double, y0: double, x1: double, y1: double>, source: string>"


def panel_rows(spans: DataFrame, layout: DataFrame) -> DataFrame:
    """sheet_id, seq, name, bbox_px of the spans in the legend panel, below its header, that read like entries; first of each name."""
    x, y = bbox_center(F.col("bbox_px"))
    s = spans.join(layout.select("sheet_id", "legend_bbox", F.col("drawing_bbox.x1").alias("rail")), "sheet_id")
    s = s.where(F.coalesce(in_bbox(x, y, F.col("legend_bbox")), F.col("bbox_px.x0") > F.col("rail")))
    header = s.where(s["text"].rlike("(?i)legend")).groupBy("sheet_id").agg(F.min_by("bbox_px.y1", "seq").alias("start"))
    s = s.join(header, "sheet_id", "left").where(F.col("bbox_px.y0") >= F.coalesce("start", F.lit(0.0)) - 2)
    s = s.withColumn("name", T.legend_name(F.col("text"))).where(T.is_legend_row(F.col("name")))
    first = F.row_number().over(W.partitionBy("sheet_id", F.upper("name")).orderBy("bbox_px.y0", "bbox_px.x0", "seq"))
    return s.withColumn("k", first).where("k = 1").select("sheet_id", "seq", "name", "bbox_px")


def folded(rows: DataFrame) -> DataFrame:
    """sheet_id, entries (array of ENTRY, in reading order): a short unknown name continues a short unknown name before it."""
    known = lambda name: T.holds_any(F.upper(name), T.KNOWN_LABELS)
    made = lambda name, box, source: F.struct(name.alias("name"), box.alias("bbox"), F.lit(source).alias("source"))
    in_order = F.array_sort(F.collect_list(F.struct(F.col("bbox_px.y0").alias("y"), F.col("bbox_px.x0").alias("x"), "seq", "name", "bbox_px")))

    def step(done, row):
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (F.length(row["name"]) <= 12) & ~known(row["name"]) & (F.length(last["name"]) <= 16) & ~known(last["name"])
        longer = made(F.concat_ws(" ", last["name"], row["name"]), last["bbox"], "pdf_legend_panel")
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(made(row["name"], row["bbox_px"], "pdf_legend_panel"))))

    return rows.groupBy("sheet_id").agg(in_order.alias("rows")).select("sheet_id", F.aggregate("rows", F.array().cast(f"array<{ENTRY}>"), step).alias("entries"))


def legends(spans: DataFrame, layout: DataFrame) -> DataFrame:
    """sheet_id, seq, name, symbol_hint, source, bbox of every sheet's legend.

    Known labels that only stand elsewhere on the sheet follow, unless an entry holds them or they hold an entry. Their box is
    that of the first span that holds them; a label that runs over neighbouring spans has none. Of names that hold one
    another, the later one goes if it is part of an earlier one of similar length.
    """
    entries = folded(panel_rows(spans, layout))
    upper = spans.select("sheet_id", "seq", F.coalesce(F.upper("text"), F.lit("")).alias("own"), "bbox_px")
    # Spans are put together with a space, so a label runs over as many spans as it has words at most.
    ahead = W.partitionBy("sheet_id").orderBy("seq").rowsBetween(0, max(len(name.split(" ")) for name in T.KNOWN_LABELS) - 1)
    upper = upper.withColumn("t", F.concat_ws(" ", F.collect_list("own").over(ahead)))
    labels = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("label")) for i, name in enumerate(T.KNOWN_LABELS)])
    found = upper.withColumn("l", F.explode(F.filter(labels, lambda l: F.contains(F.col("t"), l["label"])))).groupBy("sheet_id", "l").agg(F.min_by("bbox_px", F.when(F.contains(F.col("own"), F.col("l.label")), F.col("seq"))).alias("bbox"))
    extra = found.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("l.place", "l.label", "bbox"))).alias("extra"))
    both = spans.select("sheet_id").distinct().join(entries, "sheet_id", "left").join(extra, "sheet_id", "left")
    entry = F.coalesce("entries", F.array().cast(f"array<{ENTRY}>"))
    overlaps = lambda label, e: F.contains(F.upper(e["name"]), label) | F.contains(label, F.upper(e["name"]))
    titled = lambda label: F.initcap(F.replace(label, F.lit("-"), F.lit("- ")))

    def add(done, x):
        new = F.struct(F.replace(titled(x["label"]), F.lit("- "), F.lit("-")).alias("name"), x["bbox"].alias("bbox"), F.lit("pdf_keyword").alias("source"))
        return F.when(F.exists(done, lambda e: overlaps(x["label"], e)), done).otherwise(F.concat(done, F.array(new)))

    whole = both.select("sheet_id", F.aggregate(F.coalesce("extra", F.expr("array()")), entry, add).alias("all"))
    key = lambda e: F.upper(e["name"])

    def first(done, e):
        near = F.exists(done, lambda d: (F.abs(F.length(key(d)) - F.length(key(e))) < 12) & (F.contains(key(d), key(e)) | F.contains(key(e), key(d))))
        part = F.exists(done, lambda d: (key(d) != key(e)) & F.contains(key(d), key(e)))
        return F.when(F.exists(done, lambda d: key(d) == key(e)) | (near & part), done).otherwise(F.concat(done, F.array(e)))

    kept = whole.select("sheet_id", F.aggregate("all", F.array().cast(f"array<{ENTRY}>"), first).alias("kept"))
    rows = kept.select("sheet_id", F.posexplode("kept").alias("seq", "e"))
    return rows.select("sheet_id", "seq", "e.name", T.symbol_hint(F.upper("e.name")).alias("symbol_hint"), "e.source", "e.bbox")


def rejected_styles(legend: DataFrame) -> DataFrame:
    """sheet_id, styles: the coarse stroke styles that are no contours by the sheet's legend."""
    u = F.upper("name")
    more = F.when(F.contains(u, F.lit("SIDEWALK")) | F.contains(u, F.lit("HEAVY")), "hatch").when(F.contains(u, F.lit("CURB CUT")), "symbol")
    return legend.groupBy("sheet_id").agg(F.array_sort(F.array_union(F.array(F.lit("property_dashdot"), F.lit("building_solid")), F.collect_set(more))).alias("styles"))


def has_label(key: str) -> Column:
    """Whether any name of a legend (aggregated over its rows) holds the key."""
    return F.coalesce(F.bool_or(F.contains(F.upper("name"), F.lit(key))), F.lit(False))


def icon_boxes(legend: DataFrame, layout: DataFrame, sheets: DataFrame) -> DataFrame:
    """sheet_id, seq, name, icon: the box of pixels (half open) left of each entry's label that shows its symbol; null if too small.

    The box keeps to the legend's panel where there is one. layout: sheet_id, legend_bbox; sheets: sheet_id, height_px.
    """
    b, panel = F.col("bbox"), F.col("legend_bbox")
    t = legend.where("bbox IS NOT NULL").join(layout.select("sheet_id", "legend_bbox"), "sheet_id", "left").join(sheets.select("sheet_id", "height_px"), "sheet_id")
    tall, wide = F.greatest(F.lit(18.0), b["y1"] - b["y0"]), F.greatest(F.lit(48.0), F.least(F.lit(140.0), (b["x1"] - b["x0"]) * 0.9))
    whole = lambda v: v.cast("int")
    t = t.withColumn("ix0", whole(F.greatest(F.lit(0.0), b["x0"] - wide - 8))).withColumn("iy0", whole(F.greatest(F.lit(0.0), b["y0"] - tall * 0.35))).withColumn("iy1", whole(F.least(F.col("height_px").cast("double"), b["y1"] + tall * 0.35)))
    t = t.withColumn("ix1", whole(F.greatest(F.col("ix0") + 8.0, b["x0"] - 4)))
    inside = F.struct(F.greatest("ix0", panel["x0"]).alias("x0"), F.greatest("iy0", panel["y0"]).alias("y0"), F.least("ix1", panel["x1"]).alias("x1"), F.least("iy1", panel["y1"]).alias("y1"))
    return t.withColumn("icon", inside).select("sheet_id", "seq", "name", F.when((F.col("icon.x1") > F.col("icon.x0") + 4) & (F.col("icon.y1") > F.col("icon.y0") + 4), F.col("icon")).alias("icon"))


def swatch_rows(icons: DataFrame, gray_rows: DataFrame) -> DataFrame:
    """sheet_id, name, y, gray: the pixels of icon_boxes(), for raster.swatch_profiles(). gray_rows: sheet_id, y, gray."""
    i = F.col("icon")
    rows = icons.where("icon IS NOT NULL").join(gray_rows, "sheet_id").where((F.col("y") >= i["y0"]) & (F.col("y") < i["y1"]))
    return rows.select("sheet_id", "name", (F.col("y") - i["y0"]).alias("y"), F.substring("gray", i["x0"] + 1, i["x1"] - i["x0"]).alias("gray"))
