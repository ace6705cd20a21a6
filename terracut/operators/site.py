"""The site on a sheet: anchors, property and building outlines, interior zones, and strokes inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.functions.geometry import in_bbox, in_polygon
from terracut.functions.text import anchor_tag
from terracut.operators.polylines import coarse_style
from terracut.operators.strokes import building_strokes, densified, hulls, property_strokes
from terracut.sources.scratch import kept

RANGES = "array<struct<lo: int, hi: int>>"


def anchors(spans: DataFrame, elevations: DataFrame, layout: DataFrame) -> DataFrame:
    """sheet_id, tag, x, y (in the drawing): tagged texts and elevations inside the drawing. spans and elevations: sheet_id, x, y."""
    box = layout.select("sheet_id", "drawing_bbox")
    texts = spans.withColumn("tag", anchor_tag(F.col("text"))).where("tag IS NOT NULL").select("sheet_id", "tag", "x", "y")
    rows = texts.unionByName(elevations.select("sheet_id", F.lit("elev").alias("tag"), "x", "y"))
    d = F.col("drawing_bbox")
    return rows.join(box, "sheet_id").where(in_bbox(F.col("x"), F.col("y"), d)).select("sheet_id", "tag", (F.col("x") - d["x0"]).alias("x"), (F.col("y") - d["y0"]).alias("y"))


def room_windows(anchors_: DataFrame, width: Column, height: Column) -> DataFrame:
    """sheet_id, rooms, x0, y0, x1, y1: the box around a sheet's room labels, without strays, grown by 100; three labels at least."""
    rooms = anchors_.where("tag IN ('room', 'room_label')").select("sheet_id", "x", "y", width.alias("__w"), height.alias("__h"))
    centre = rooms.groupBy("sheet_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    r = rooms.join(centre, "sheet_id").withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    med = r.groupBy("sheet_id").agg(F.median("d").alias("med"))
    r = r.join(med, "sheet_id").withColumn("near", F.col("d") <= F.greatest(F.lit(180.0), F.col("med") * 2.6))
    enough = r.groupBy("sheet_id").agg((F.count_if("near") >= 3).alias("enough"))
    kept = r.join(enough, "sheet_id").where("near OR NOT enough")
    return kept.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("rooms"),
        F.floor(F.greatest(F.lit(0.0), F.min("x") - 100)).alias("x0"), F.floor(F.greatest(F.lit(0.0), F.min("y") - 100)).alias("y0"),
        F.floor(F.least(F.max("__w") - 1, F.max("x") + 100)).alias("x1"), F.floor(F.least(F.max("__h") - 1, F.max("y") + 100)).alias("y1"),
    )


def near_walls(wall_points: DataFrame, windows: DataFrame) -> DataFrame:
    """sheet_id, chain of the wall strokes (points: sheet_id, chain, length, x, y) with 35 % of their points in the room window grown by 30."""
    inside = F.col("x").between(F.col("x0") - 30, F.col("x1") + 30) & F.col("y").between(F.col("y0") - 30, F.col("y1") + 30)
    share = wall_points.join(windows, "sheet_id").groupBy("sheet_id", "chain", "length").agg(F.avg(inside.cast("double")).alias("share"))
    walls = share.where("share >= 0.35 AND length >= 40").select("sheet_id", "chain")
    many = walls.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("sheet_id")
    return walls.join(many, "sheet_id", "left_semi")


def buildings(wall_points: DataFrame, anchors_: DataFrame, width: Column, height: Column) -> DataFrame:
    """sheet_id, building_polygon (null unless it holds enough rooms), building_bbox: the hull of the walls near room labels."""
    windows = kept(room_windows(anchors_, width, height), "room-windows")
    walls = kept(wall_points.join(near_walls(wall_points, windows), ["sheet_id", "chain"], "left_semi"), "near-walls")
    ring = hulls(walls, ["sheet_id"]).join(windows.select("sheet_id", "rooms", "x0", "y0", "x1", "y1"), "sheet_id")
    rooms = anchors_.where("tag IN ('room', 'room_label')").join(ring, "sheet_id").where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    held = rooms.groupBy("sheet_id").agg(F.count_if(in_polygon(F.col("x"), F.col("y"), F.col("hull"))).alias("held"))
    box = walls.groupBy("sheet_id").agg(F.struct(*[F.floor(f(F.col(c).cast("float"))).cast("int").alias(f"{c}{k}") for k, f in ((0, F.min), (1, F.max)) for c in ("x", "y")]).alias("building_bbox"))
    confirmed = F.col("held") >= F.greatest(F.lit(2), F.floor(F.col("rooms") * 0.45))
    return ring.join(held, "sheet_id", "left").join(box, "sheet_id").select("sheet_id", F.when(confirmed, F.col("hull")).alias("building_polygon"), "building_bbox")


def property_outline(line_points: DataFrame) -> DataFrame:
    """sheet_id, property_polygon (hull of three lines or more), property_bbox, of the points of property lines (sheet_id, chain, x, y)."""
    n = line_points.groupBy("sheet_id").agg(F.count_distinct("chain").alias("n"), F.struct(*[F.floor(f(F.col(c).cast("float"))).cast("int").alias(f"{c}{k}") for k, f in ((0, F.min), (1, F.max)) for c in ("x", "y")]).alias("property_bbox"))
    return n.join(hulls(line_points, ["sheet_id"]), "sheet_id").select("sheet_id", F.when((F.col("n") >= 3) & (F.size("hull") >= 3), F.col("hull")).alias("property_polygon"), "property_bbox")


def is_interior(x: Column, y: Column, property_polygon: Column, building_polygon: Column, building_bbox: Column) -> Column:
    """Inside the property (everywhere, if unknown) and outside the building's outline, or its box if there is no outline."""
    inside = F.when(property_polygon.isNull(), True).otherwise(in_polygon(x, y, property_polygon))
    built = F.when(building_polygon.isNotNull(), in_polygon(x, y, building_polygon)).when(building_bbox.isNotNull(), (x >= building_bbox["x0"]) & (x < building_bbox["x1"]) & (y >= building_bbox["y0"]) & (y < building_bbox["y1"])).otherwise(False)
    return inside & ~built


def row_ranges(ring: Column, y: Column, width: Column) -> Column:
    """The ranges (lo, hi; whole pixels, hi included) of a pixel row inside a ring, by in_polygon()'s rule, cut to 0 .. width - 1."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, after, lambda p, q: F.when((p["y"] > y) != (q["y"] > y), (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"]) + p["x"]))
    # A pixel is inside when an odd number of crossings lies beyond it: from one crossing up to before the next.
    at = F.transform(F.array_sort(F.array_compact(cross)), lambda v: F.ceil(v))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(at) / 2) - 1), lambda k: pixels(F.element_at(at, (2 * k + 1).cast("int")), F.element_at(at, (2 * k + 2).cast("int")) - 1, width))
    return F.when(F.size(at) >= 2, F.filter(pairs, lambda r: r["lo"] <= r["hi"])).otherwise(F.array().cast(RANGES))


def pixels(lo: Column, hi: Column, width: Column) -> Column:
    return F.struct(F.greatest(F.lit(0), lo).cast("int").alias("lo"), F.least(width - 1, hi).cast("int").alias("hi"))


def without(ranges: Column, holes: Column, width: Column) -> Column:
    """Parts of ranges outside of holes; both in order, each without overlaps."""
    before = F.concat(F.array(F.lit(-1)), F.transform(holes, lambda h: h["hi"]))
    behind = F.concat(F.transform(holes, lambda h: h["lo"]), F.array(width))
    free = F.zip_with(before, behind, lambda a, b: pixels(a + 1, b - 1, width))
    parts = F.flatten(F.transform(ranges, lambda r: F.transform(free, lambda g: pixels(F.greatest(r["lo"], g["lo"]), F.least(r["hi"], g["hi"]), width))))
    return F.filter(parts, lambda r: r["lo"] <= r["hi"])


def zones(site: DataFrame, tile: tuple[int, int] = (480, 400)) -> DataFrame:
    """sheet_id, seq, bbox: tiles of the drawing (site: sheet_id, width, height, outlines) that are interior enough, cut to what is interior.

    Every pixel counts: a pixel row's interior is a few ranges between crossings of the outlines, and a tile adds up what
    they have in it. A tile needs an interior share of 40 / 255 and a box of over 100 x 100.
    """
    rows = site.withColumn("py", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    y, w, b = F.col("py").cast("double"), F.col("width"), F.col("building_bbox")
    none = F.array().cast(RANGES)
    inside = F.when(F.col("property_polygon").isNull(), F.array(pixels(F.lit(0), w - 1, w))).otherwise(row_ranges(F.col("property_polygon"), y, w))
    boxed = F.when((F.col("py") >= b["y0"]) & (F.col("py") < b["y1"]) & (b["x0"] < b["x1"]), F.filter(F.array(pixels(b["x0"], b["x1"] - 1, w)), lambda r: r["lo"] <= r["hi"])).otherwise(none)
    built = F.when(F.col("building_polygon").isNotNull(), row_ranges(F.col("building_polygon"), y, w)).otherwise(F.coalesce(boxed, none))
    free = rows.withColumn("r", F.explode(without(inside, built, w))).withColumn("tx", F.explode(F.sequence(F.floor(F.col("r.lo") / tile[0]), F.floor(F.col("r.hi") / tile[0]))))
    free = free.withColumn("lo", F.greatest(F.col("r.lo").cast("long"), F.col("tx") * tile[0])).withColumn("hi", F.least(F.col("r.hi").cast("long"), (F.col("tx") + 1) * tile[0] - 1))
    t = free.groupBy("sheet_id", "width", "height", F.floor(F.col("py") / tile[1]).alias("ty"), "tx").agg(
        F.sum(F.col("hi") - F.col("lo") + 1).alias("free"), F.min("lo").cast("int").alias("x0"), F.max("hi").cast("int").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"),
    )
    area = (F.least(w, (F.col("tx") + 1) * tile[0]) - F.col("tx") * tile[0]) * (F.least(F.col("height"), (F.col("ty") + 1) * tile[1]) - F.col("ty") * tile[1])
    t = t.where(F.col("free") / area >= 40.0 / 255.0).where("x1 - x0 > 100 AND y1 - y0 > 100")
    return t.select("sheet_id", (F.row_number().over(W.partitionBy("sheet_id").orderBy("ty", "tx")) - 1).alias("seq"), F.struct("x0", "y0", "x1", "y1").alias("bbox"))


def inside_shares(points: DataFrame, site: DataFrame) -> DataFrame:
    """sheet_id, poly_seq, share: the part of each polyline's vertices that is interior. site: sheet_id and its outlines."""
    p = points.join(site.select("sheet_id", "property_polygon", "building_polygon", "building_bbox"), "sheet_id")
    free = is_interior(F.col("x").cast("double"), F.col("y").cast("double"), F.col("property_polygon"), F.col("building_polygon"), F.col("building_bbox"))
    return p.groupBy("sheet_id", "poly_seq").agg(F.avg(free.cast("double")).alias("share"))


def wall_like(points: DataFrame, metrics: DataFrame, site: DataFrame) -> DataFrame:
    """sheet_id, poly_seq of long straight strokes with most of their vertices around the building's box."""
    straight = metrics.where("mean_abs_turn < 0.08 AND straightness >= 0.93 AND length_px >= 80").select("sheet_id", "poly_seq")
    b = F.col("building_bbox")
    near = F.col("x").between(b["x0"] - 40, b["x1"] + 40) & F.col("y").between(b["y0"] - 40, b["y1"] + 40)
    p = points.join(straight, ["sheet_id", "poly_seq"], "left_semi").join(site.where("building_bbox IS NOT NULL").select("sheet_id", "building_bbox"), "sheet_id")
    return p.groupBy("sheet_id", "poly_seq").agg(F.avg(near.cast("double")).alias("share")).where("share > 0.6").select("sheet_id", "poly_seq")


def topo_filter(points: DataFrame, metrics: DataFrame, kinds: DataFrame, site: DataFrame, styles: DataFrame, least_inside: float = 0.55) -> DataFrame:
    """sheet_id, poly_seq, keep: whether a stroke is a contour: no site stroke, no rejected style, no wall, mostly interior.

    styles: sheet_id, styles (rejected ones).
    """
    m = metrics.join(kinds, ["sheet_id", "poly_seq"]).join(styles, "sheet_id", "left").join(inside_shares(points, site), ["sheet_id", "poly_seq"], "left")
    m = m.join(wall_like(points, metrics, site).withColumn("wall", F.lit(True)), ["sheet_id", "poly_seq"], "left").withColumn("style", coarse_style(F.col("kind")))
    rejected = F.coalesce(F.array_contains("styles", F.col("style")), F.col("style").isin("property_dashdot", "building_solid"))
    boundary = (F.col("style") == "property_dashdot") & (F.col("length_px") > 200) & (F.col("straightness") > 0.9)
    keep = ~F.col("kind").isin("property", "building", "structure") & ~rejected & F.col("wall").isNull() & ~boundary & (F.coalesce("share", F.lit(1.0)) >= least_inside)
    return m.select("sheet_id", "poly_seq", keep.alias("keep"))


def moved(x: Column, y: Column, box: Column, sign: int) -> tuple[Column, Column]:
    """A point from the page to the drawing's frame (sign -1), or back (sign 1)."""
    return x + sign * box["x0"], y + sign * box["y0"]


def lifted_ring(ring: Column, box: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] + box["x0"]).alias("x"), (p["y"] + box["y0"]).alias("y")))


def lifted_box(inner: Column, box: Column) -> Column:
    return F.when(inner.isNotNull(), F.struct(*[(inner[c] + box[c[0] + "0"]).alias(c) for c in ("x0", "y0", "x1", "y1")]))


def site_structure(segments: DataFrame, spans: DataFrame, elevations: DataFrame, layout: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Site of every sheet, in page pixels, and its zones (sheet_id, seq, bbox).

    Site: sheet_id, property_polygon, property_bbox, building_polygon, building_bbox, n_property, n_building (lines traced),
    interior frame (width, height) and notes. segments: SEGMENT rows; spans and elevations: sheet_id, text, x, y; layout:
    sheet_id, drawing_bbox; sheets: sheet_id, role. Existing sheets have no building. Sheets without strokes have null
    outlines, and all of their drawing is interior.
    """
    d = F.col("drawing_bbox")
    frame = layout.select("sheet_id", "drawing_bbox", (d["x1"] - d["x0"]).alias("width"), (d["y1"] - d["y0"]).alias("height")).join(sheets.select("sheet_id", "role"), "sheet_id")

    def local(lines: DataFrame) -> DataFrame:
        p = densified(lines).select("sheet_id", "chain", "length", F.explode("points").alias("p")).join(frame.select("sheet_id", "drawing_bbox"), "sheet_id")
        x, y = moved(F.col("p.x"), F.col("p.y"), F.col("drawing_bbox"), -1)
        return p.select("sheet_id", "chain", "length", x.alias("x"), y.alias("y"))

    drawn = segments.join(sheets.where("role != 'existing'").select("sheet_id"), "sheet_id", "left_semi")
    edges, walls = kept(local(property_strokes(segments)), "property-points"), kept(local(building_strokes(drawn)), "wall-points")
    sized = anchors(spans, elevations, layout).join(frame.select("sheet_id", "width", "height"), "sheet_id")
    built = buildings(walls, sized, F.col("width"), F.col("height"))
    count = lambda t, name: t.groupBy("sheet_id").agg(F.count_distinct("chain").alias(name))
    site = frame.join(property_outline(edges), "sheet_id", "left").join(built, "sheet_id", "left").join(count(edges, "n_property"), "sheet_id", "left").join(count(walls, "n_building"), "sheet_id", "left")
    site = kept(site.fillna({"n_property": 0, "n_building": 0}), "site")
    zone = zones(site).join(frame.select("sheet_id", "drawing_bbox"), "sheet_id").select("sheet_id", "seq", lifted_box(F.col("bbox"), d).alias("bbox"))
    seen = lambda n, other: F.when(F.col(n) > 0, "pdf").otherwise(other)
    notes = F.concat(
        F.lit("property="), seen("n_property", F.lit("miss")), F.lit("(n="), F.col("n_property"), F.lit("); building="), seen("n_building", F.when(F.col("role") == "existing", "skip").otherwise("miss")),
        F.lit("(n="), F.col("n_building"), F.lit("); role="), F.col("role"),
    )
    outlines = site.select(
        "sheet_id", lifted_ring(F.col("property_polygon"), d).alias("property_polygon"), lifted_box(F.col("property_bbox"), d).alias("property_bbox"), lifted_ring(F.col("building_polygon"), d).alias("building_polygon"),
        lifted_box(F.col("building_bbox"), d).alias("building_bbox"), "n_property", "n_building", "width", "height", notes.alias("notes"),
    )
    return outlines, zone
