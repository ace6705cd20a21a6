"""From plan tables to volumes: one sheet alone, or an existing and a proposed sheet fused, for all sites at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracut.operators import associate, elevations, layers, layout, legend, polylines, scales, site, styles, surfaces, volumes
from terracut.operators.surfaces import SAMPLES
from terracut.params import DEFAULTS, Params
from terracut.sources.scratch import kept
from terracut.sources.tables import saved


@dataclass
class SheetTables:
    """What is known of sheets before volumes."""

    layout: DataFrame
    scales: DataFrame
    elevations: DataFrame
    polylines: DataFrame  # sheet_id, poly_seq, kind
    associations: DataFrame


def placed_spans(spans: DataFrame) -> DataFrame:
    """sheet_id, seq, text and the middle of each span's box."""
    return spans.select("sheet_id", "seq", "text", ((F.col("bbox_px.x0") + F.col("bbox_px.x1")) / 2).alias("x"), ((F.col("bbox_px.y0") + F.col("bbox_px.y1")) / 2).alias("y"))


def understand(sheets: DataFrame, spans: DataFrame, points: DataFrame, kinds: DataFrame, workspace: str, params: Params = DEFAULTS, recognised: DataFrame | None = None) -> SheetTables:
    """Layout, scale, callouts, contours and associations of every sheet, as tables in the folder workspace.

    sheets: sheet_id, role, width_px, height_px. spans: sheet_id, seq, text, bbox_px. points: sheet_id, poly_seq, pos, x, y.
    kinds: sheet_id, poly_seq, kind (as styled). recognised: texts read from pixels, as elevations() takes them.
    """
    plan = saved(layout.layouts(spans, sheets), f"{workspace}/layout")
    placed = placed_spans(spans)
    found = saved(elevations.elevations(placed, sheets.select("sheet_id", "role").join(plan, "sheet_id"), params, recognised), f"{workspace}/elevations")
    contours = kinds.join(sheets.select("sheet_id", "role"), "sheet_id").withColumn("kind", styles.contour_kind(F.col("kind"), F.col("role"))).where("kind IS NOT NULL").select("sheet_id", "poly_seq", "kind")
    lines = points.join(contours, polylines.KEY, "left_semi")
    # Existing sheets' labels stand farther from their contours.
    reach = {"existing": 160.0, "other": params.max_dist}
    of = lambda t, existing: t.join(sheets.where("role = 'existing'" if existing else "role != 'existing'").select("sheet_id"), "sheet_id", "left_semi")
    joined = associate.associate(of(found, True), of(lines, True), of(contours, True), reach["existing"]).unionByName(associate.associate(of(found, False), of(lines, False), of(contours, False), reach["other"]))
    return SheetTables(plan, saved(scales.detect_scales(placed, sheets, params), f"{workspace}/scales"), found, contours, saved(joined, f"{workspace}/associations"))


def samples_px(t: SheetTables, points: DataFrame, roles: DataFrame, single_sheet: bool, workspace: str, params: Params = DEFAULTS) -> DataFrame:
    """sample_rows() as a table in the folder workspace."""
    return saved(sample_rows(t, points, roles, single_sheet, params), f"{workspace}/samples")


def sample_rows(t: SheetTables, points: DataFrame, roles: DataFrame, single_sheet: bool, params: Params = DEFAULTS) -> DataFrame:
    """sheet_id, surface, seq, x, y (page pixels), z: every callout, and points of the contours that callouts belong to.

    A contour of a callout gives about six points (eight on existing sheets) and the foot, all at the callout's height. On
    existing sheets with few associations, a looser search adds about ten points of each contour it finds. Samples are a
    bag: a place may come more than once.
    """
    order = F.col("seq").cast("long") * 100_000
    e = t.elevations.join(roles, "sheet_id")
    own = e.select("sheet_id", F.when(F.col("role") == "existing", "existing").otherwise(surfaces.elevation_surface(F.col("kind"), single_sheet)).alias("surface"), order.alias("seq"), "x", "y", F.col("value_ft").alias("z")).where("surface IS NOT NULL")
    heights = t.elevations.select("sheet_id", "seq", F.col("value_ft").alias("z"))

    def contour_points(found: DataFrame, k: int, roles_: DataFrame, start: int, foot: bool) -> DataFrame:
        a = found.join(roles_, "sheet_id").join(heights, ["sheet_id", "seq"]).join(t.polylines.withColumnRenamed("kind", "poly_kind"), polylines.KEY)
        surface = F.when((F.col("role") == "existing") | (F.col("poly_kind") == "existing"), "existing").otherwise("proposed")
        vertices = a.join(polylines.strided(points, k).select(*polylines.KEY, "pos", F.col("x").alias("vx"), F.col("y").alias("vy")), polylines.KEY)
        rows = vertices.select("sheet_id", surface.alias("surface"), (order + start + F.col("pos")).alias("seq"), F.col("vx").alias("x"), F.col("vy").alias("y"), "z")
        if foot:
            last = F.when(F.col("role") == "existing", 1).otherwise(start + 40_000)
            rows = rows.unionByName(a.select("sheet_id", surface.alias("surface"), (order + last).alias("seq"), F.col("foot_x").alias("x"), F.col("foot_y").alias("y"), "z"))
        return rows

    existing, others = roles.where("role = 'existing'"), roles.where("role != 'existing'")
    out = own.unionByName(contour_points(t.associations, 6, others, 10, True)).unionByName(contour_points(t.associations, 8, existing, 10, True))
    n = t.elevations.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n")).join(t.associations.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("a")), "sheet_id", "left")
    sparse = n.where(F.coalesce("a", F.lit(0)) < F.greatest(F.lit(3), F.floor(F.col("n") / 2))).join(existing, "sheet_id").select("sheet_id", "role")
    few = lambda d: d.join(sparse, "sheet_id", "left_semi")
    loose = associate.associate(few(t.elevations), few(points), few(t.polylines), params.loose_dist)
    return out.unionByName(contour_points(loose, 10, sparse, 50_000, False))


def to_feet(samples: DataFrame, sheets: DataFrame, t: SheetTables, site: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SAMPLES of samples_px() rows around the property's (building's, page's) centre, and site_id, w, h: the property in feet.

    sheets: sheet_id, site_id, dpi, width_px, height_px. site: sheet_id, property_bbox, building_bbox.
    """
    f = sheets.join(t.scales.select("sheet_id", "ft_per_inch"), "sheet_id").withColumn("ft", F.col("ft_per_inch") / F.col("dpi"))
    f = f.join(site.select("sheet_id", "property_bbox", "building_bbox"), "sheet_id", "left") if site is not None else f.withColumn("property_bbox", F.lit(None).cast("struct<x0: int, y0: int, x1: int, y1: int>")).withColumn("building_bbox", F.col("property_bbox"))
    p, b = F.col("property_bbox"), F.col("building_bbox")
    middle = lambda lo, hi, size: F.coalesce((p[lo] + p[hi]) / 2, (b[lo] + b[hi]) / 2, F.col(size) / 2)
    size = lambda lo, hi, page: F.coalesce((p[hi] - p[lo]) * F.col("ft"), F.col(page) * F.col("ft") * 0.5)
    f = f.select("sheet_id", "site_id", "ft", middle("x0", "x1", "width_px").alias("ox"), middle("y0", "y1", "height_px").alias("oy"), size("x0", "x1", "width_px").alias("w"), size("y0", "y1", "height_px").alias("h"))
    feet = samples.join(f, "sheet_id").select("site_id", "surface", "seq", ((F.col("x") - F.col("ox")) * F.col("ft")).alias("x_ft"), ((F.col("y") - F.col("oy")) * F.col("ft")).alias("y_ft"), "z")
    return feet.select(*SAMPLES), f.select("site_id", "w", "h")


def single_sheet_volumes(samples: DataFrame, elevation_samples: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Volumes of each site from one sheet's samples (SAMPLES)."""
    grid = surfaces.build_surfaces(kept(surfaces.with_fallback(samples, elevation_samples, params), "samples"), params.grid_n, params)
    return volumes.cut_fill(grid, ["site_id"])


def fused_volumes(proposed: tuple[DataFrame, DataFrame], existing: tuple[DataFrame, DataFrame], truth: DataFrame | None = None, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame | None]:
    """Volumes of each site from to_feet() of its proposed and its existing sheets, and their score if truth is known."""
    frames = proposed[1].select("site_id", F.col("w").alias("pw"), F.col("h").alias("ph")).join(existing[1].select("site_id", F.col("w").alias("ew"), F.col("h").alias("eh")), "site_id", "left")
    v = volumes.cut_fill(surfaces.fuse_surfaces(proposed[0], existing[0], frames, params.fused_grid_n, params), ["site_id"])
    return v, None if truth is None else volumes.evaluate(v, truth, ["site_id"], params.tolerance_pct)


def styled_kinds(points: DataFrame, samples: DataFrame, kinds: DataFrame, sheets: DataFrame, templates: DataFrame) -> DataFrame:
    """sheet_id, poly_seq, kind after styling by ink. samples: sheet_id, poly_seq, pos, gray (raster.profile_samples()). Property
    lines are left out; strokes without samples keep their kind."""
    p = styles.profiles(samples, polylines.KEY).join(polylines.metrics(points).select(*polylines.KEY, "straightness", "length_px", "mean_abs_turn"), polylines.KEY)
    found = styles.styles(p, templates, polylines.KEY).select(*polylines.KEY, "style")
    t = kinds.join(found, polylines.KEY, "left").join(sheets.select("sheet_id", "role"), "sheet_id")
    kind = F.when(F.col("style").isNull(), F.col("kind")).otherwise(styles.styled_kind(F.col("style"), F.col("kind"), F.col("role")))
    return t.select(*polylines.KEY, kind.alias("kind")).where("kind IS NOT NULL")


@dataclass
class Detection:
    """All that one run over sheets finds."""

    tables: SheetTables
    site: DataFrame
    zones: DataFrame
    regions: DataFrame
    legend: DataFrame
    samples: DataFrame  # SAMPLES, in feet
    frames: DataFrame  # site_id, w, h
    volumes: DataFrame  # of each site
    status: DataFrame  # sheet_id, status, warnings


def detect(sheets: DataFrame, spans: DataFrame, segments: DataFrame, points: DataFrame, kinds: DataFrame, workspace: str, params: Params = DEFAULTS, recognised: DataFrame | None = None) -> Detection:
    """Each sheet alone, from its texts, strokes and contours to volumes and status, for all sheets at once.

    sheets: sheet_id, site_id, role, dpi, width_px, height_px, one sheet for each site. spans, points, kinds and recognised:
    as understand() takes them; segments: SEGMENT rows in page pixels. Existing sheets give samples, and no volumes.
    """
    t = understand(sheets, spans, points, kinds, workspace, params, recognised)
    found, zones = site.site_structure(segments, placed_spans(spans), t.elevations, t.layout, sheets)
    names = saved(legend.legends(spans, t.layout), f"{workspace}/legend")
    roles = sheets.select("sheet_id", "role")
    px = samples_px(t, points, roles, True, workspace, params)
    feet, frames = to_feet(px, sheets, t, found)
    feet = saved(feet, f"{workspace}/feet")
    callouts, _ = to_feet(t.elevations.select("sheet_id", F.lit("proposed").alias("surface"), "seq", "x", "y", F.col("value_ft").alias("z")), sheets, t, found)
    computed = sheets.where("role != 'existing'").select("site_id")
    own = lambda d: d.join(computed, "site_id", "left_semi")
    v = saved(single_sheet_volumes(own(feet), own(callouts), params), f"{workspace}/volumes")
    n = lambda d, name: d.groupBy("sheet_id").agg(F.count(F.lit(1)).alias(name))
    s = sheets.select("sheet_id", "site_id", "role").join(t.scales.select("sheet_id", F.col("source").alias("scale_source")), "sheet_id", "left").join(found.select("sheet_id", "n_property", "n_building"), "sheet_id", "left")
    for table, name in ((names, "n_legend"), (t.elevations, "n_elevations"), (t.polylines, "n_polylines"), (t.associations, "n_associations"), (px.where("surface = 'existing'"), "n_existing_samples")):
        s = s.join(n(table, name), "sheet_id", "left")
    s = s.join(v.select("site_id", "ok"), "site_id", "left").fillna(0).fillna(False, ["ok"]).withColumn("computed", F.lit(True))
    return Detection(t, found, zones, layout.with_site(layout.regions(t.layout), found, zones), names, feet, frames, v, layers.stage_status(s))
