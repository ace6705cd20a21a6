"""What a viewer or report needs: vertices by layer, the view window, and stage status with warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hex_color(v: Column) -> Column:
    """array(blue, green, red) of #RRGGBB."""
    part = lambda at: F.conv(F.substring(v, at, 2), 16, 10).cast("int")
    return F.array(part(6), part(4), part(2))


def layer_vertices(points: DataFrame, kinds: DataFrame, scale: float = 1.0) -> DataFrame:
    """layer, sheet_id, poly_seq, pos, x, y: contour vertices with a row of nulls after each path. Site strokes are no layer of
    contours; every kind but existing is drawn as proposed. Paths of one point are left out."""
    layer = F.when(F.col("kind") == "existing", "existing").otherwise("proposed")
    p = points.join(kinds.where("kind NOT IN ('structure', 'property', 'building')").select("sheet_id", "poly_seq", layer.alias("layer")), ["sheet_id", "poly_seq"])
    path = p.groupBy("layer", "sheet_id", "poly_seq").agg(F.count(F.lit(1)).cast("int").alias("pos")).where("pos > 1")
    nothing = F.lit(None).cast("double")
    rows = p.join(path.select("sheet_id", "poly_seq"), ["sheet_id", "poly_seq"], "left_semi").select("layer", "sheet_id", "poly_seq", "pos", (F.col("x") * scale).cast("double").alias("x"), (F.col("y") * scale).cast("double").alias("y"))
    return rows.unionByName(path.select("*", nothing.alias("x"), nothing.alias("y")))


def view_windows(layout: DataFrame, site: DataFrame, scale: float = 1.0, pad: float = 20.0) -> DataFrame:
    """sheet_id, x0, x1, y0, y1: the view on the property, or the drawing, with a margin, inside the page (width_px, height_px)."""
    f = F.coalesce("property_bbox", "drawing_bbox")
    t = layout.join(site.select("sheet_id", "property_bbox"), "sheet_id", "left").withColumn("f", f)
    lo = lambda v: F.greatest(F.lit(0.0), (F.col("f")[v] - pad) * scale)
    hi = lambda v, size: F.least(F.col(size) * scale, (F.col("f")[v] + pad) * scale)
    return t.select("sheet_id", lo("x0").alias("x0"), hi("x1", "width_px").alias("x1"), lo("y0").alias("y0"), hi("y1", "height_px").alias("y1"))


def display_scale(width: Column, most: Column) -> Column:
    """The factor that makes a page no wider than most pixels; 1 where it is not."""
    return F.when(width <= most, 1.0).otherwise(most / width)


def contour_notes(kinds: DataFrame, counts: DataFrame, dropped: DataFrame) -> DataFrame:
    """sheet_id, existing_vs_proposed, notes: how a sheet's contours came about, as text.

    kinds: sheet_id, poly_seq, kind (of the contours that stay). counts: raster.contour_counts() with seeds_tried. dropped:
    sheet_id, style_drop, rejected (strokes that were no contours).
    """
    n = kinds.groupBy("sheet_id").agg(F.count_if(F.col("kind") == "existing").alias("existing"), F.count_if(F.col("kind") == "proposed").alias("proposed"))
    t = counts.join(n, "sheet_id", "left").join(dropped, "sheet_id", "left").fillna(0, ["existing", "proposed", "style_drop", "rejected"])
    text = lambda c: F.col(c).cast("string")
    mean = F.format_string("%.0f", F.bround(F.coalesce("mean_length", F.lit(0.0)), 0))
    told = F.concat(
        F.lit("existing="), text("existing"), F.lit(", proposed="), text("proposed"), F.lit("; seeded="), text("seeds_hit"), F.lit("/"), text("seeds_tried"), F.lit(", closed="), text("closed"), F.lit(", open="), text("open"),
        F.lit(", mean_len="), mean, F.lit("px, fallback="), text("fallback"), F.lit(", style_drop="), text("style_drop"),
    )
    lost = F.col("style_drop") + F.col("rejected")
    notes = F.array_compact(F.array(
        F.when(lost > 0, F.concat(F.lit("dropped "), lost.cast("string"), F.lit(" strokes that are no contours"))),
        F.concat(F.lit("contours: seeds_hit="), text("seeds_hit"), F.lit(", closed="), text("closed"), F.lit(", mean_length="), mean, F.lit("px, fallback="), text("fallback")),
    ))
    return t.select("sheet_id", told.alias("existing_vs_proposed"), notes.alias("notes"))


def fused_status(volumes: DataFrame, samples: DataFrame, least_points: int = 3) -> DataFrame:
    """site_id, cut_fill (fused or failed), existing_vs_proposed, warnings of two sheets' volumes. samples: of fuse_samples()."""
    n = samples.groupBy("site_id").agg(*[F.count_if(F.col("surface") == s).alias(s) for s in ("existing", "proposed")])
    t = volumes.select("site_id", "ok").join(n, "site_id", "left").fillna(0, ["existing", "proposed"])
    told = lambda a, b: F.concat(F.lit(a), F.col("existing").cast("string"), F.lit(b), F.col("proposed").cast("string"))
    warnings = F.array_compact(F.array(told("fused surfaces: existing_pts=", ", proposed_pts="), F.when(F.col("existing") < least_points, "few existing-surface samples even when fused")))
    return t.select("site_id", F.when(F.col("ok"), "fused").otherwise("failed").alias("cut_fill"), told("fused existing_pts=", ", proposed_pts=").alias("existing_vs_proposed"), warnings.alias("warnings"))


def stage_status(s: DataFrame) -> DataFrame:
    """sheet_id, status (map), warnings (array). s: sheet_id, role, scale_source, n_legend, n_elevations, n_property, n_building,
    n_polylines, n_associations, n_existing_samples, computed (volumes wanted), ok (volumes found)."""
    some = lambda c: F.when(F.col(c) > 0, "done").otherwise("empty")
    volumes = F.when(F.col("role") == "existing", "deferred").when(~F.col("computed"), "skipped").when(F.col("ok"), "done").otherwise("failed")
    status = F.create_map(
        F.lit("segments"), F.lit("done"), F.lit("scale"), F.when(F.col("scale_source") == "default", "default").otherwise("done"), F.lit("legend"), some("n_legend"), F.lit("elevations"), some("n_elevations"),
        F.lit("property"), some("n_property"), F.lit("building"), some("n_building"), F.lit("contours"), some("n_polylines"), F.lit("association"), some("n_associations"), F.lit("cut_fill"), volumes,
    )
    rate = F.col("n_associations") / F.greatest(F.col("n_elevations"), F.lit(1))
    warnings = F.array_compact(F.array(
        F.when(F.col("scale_source") == "default", "scale not found on the sheet"),
        F.when(F.col("n_elevations") == 0, "no elevation callouts in the drawing"),
        F.when(F.col("n_property") == 0, "property boundary not traced"),
        F.when((F.col("n_building") == 0) & (F.col("role") == "proposed"), "building not detected"),
        F.when((F.col("n_elevations") > 0) & (F.col("n_associations") > 0) & (rate < 0.35), "few elevations associated with contours"),
        F.when((F.col("role") != "existing") & F.col("computed") & (F.col("n_existing_samples") < 3), "few existing-surface samples on this sheet"),
    ))
    return s.select("sheet_id", status.alias("status"), warnings.alias("warnings"))
