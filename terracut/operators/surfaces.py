"""Surfaces from scattered elevations: samples, grids, triangulated and nearest interpolation, and fusing two sheets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracut.operators import facets
from terracut.operators.spatial import nearest
from terracut.params import DEFAULTS, Params
from terracut.sources.scratch import kept

SAMPLES = ["site_id", "surface", "seq", "x_ft", "y_ft", "z"]


def elevation_surface(kind: Column, single_sheet: bool) -> Column:
    """The surface that a callout speaks of: match-existing callouts the existing one, others the proposed one."""
    return F.when(kind == "existing_match", "existing").when(kind.isin("ffe", "spot", "weak") | F.lit(not single_sheet), "proposed")


def with_fallback(samples: DataFrame, elevations: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """samples, where sites with too few proposed ones take all their elevations (site_id, seq, x_ft, y_ft, z) as proposed instead."""
    few = elevations.groupBy("site_id").agg(F.count(F.lit(1)).alias("__e")).join(samples.where("surface = 'proposed'").groupBy("site_id").agg(F.count(F.lit(1)).alias("__p")), "site_id", "left")
    few = few.where(F.coalesce("__p", F.lit(0)) < params.least_points).select("site_id")
    kept = samples.join(few, "site_id", "left_anti").unionByName(samples.where("surface = 'existing'").join(few, "site_id", "left_semi"))
    return kept.unionByName(elevations.join(few, "site_id", "left_semi").withColumn("surface", F.lit("proposed")).select(*SAMPLES))


def extents(samples: DataFrame, grid_n: int, pad_share: float) -> DataFrame:
    """site_id, x0, y0, dx, dy, cell_ft: a grid of grid_n x grid_n nodes around all samples of a site, with a margin.

    cell_ft is the longer of the two steps; volumes count it for both.
    """
    e = samples.groupBy("site_id").agg(*[f(c).cast("double").alias(f"{n}{c[0]}") for c in ("x_ft", "y_ft") for n, f in (("lo_", F.min), ("hi_", F.max))])
    pad = F.lit(pad_share) * F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y"), F.lit(1.0))
    step = lambda a: (F.col(f"hi_{a}") - F.col(f"lo_{a}") + 2 * F.col("pad")) / (grid_n - 1)
    return e.withColumn("pad", pad).select("site_id", (F.col("lo_x") - F.col("pad")).alias("x0"), (F.col("lo_y") - F.col("pad")).alias("y0"), step("x").alias("dx"), step("y").alias("dy")).withColumn("cell_ft", F.greatest("dx", "dy"))


def cells(extent: DataFrame, grid_n: int) -> DataFrame:
    """site_id, i (row), j (column), x, y, cell_ft: the nodes of each site's grid."""
    row = F.explode(F.sequence(F.lit(0), F.lit(grid_n - 1)))
    g = extent.withColumn("i", row).withColumn("j", row)
    return g.select("site_id", "i", "j", (F.col("x0") + F.col("j") * F.col("dx")).alias("x"), (F.col("y0") + F.col("i") * F.col("dy")).alias("y"), "cell_ft")


def distinct_places(samples: DataFrame) -> DataFrame:
    """Samples with one row for each place of a surface, that of the smallest seq."""
    return samples.groupBy("site_id", "surface", "x_ft", "y_ft").agg(F.min("seq").alias("seq"), F.min_by("z", F.struct("seq", "z")).alias("z"))


def circles(px: np.ndarray, py: np.ndarray, t: np.ndarray) -> np.ndarray:
    """x, y and squared radius of the circle through the corners of each triangle (rows of three point numbers)."""
    ax, ay = px[t[:, 0]], py[t[:, 0]]
    bx, by, cx, cy = px[t[:, 1]] - ax, py[t[:, 1]] - ay, px[t[:, 2]] - ax, py[t[:, 2]] - ay
    d = 2 * (bx * cy - by * cx)
    d = np.where(d == 0, 1e-300, d)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return np.stack([ax + ux, ay + uy, ux * ux + uy * uy], axis=1)


#: Points after which triangles that are final are set aside.
SWEEP = 64


def delaunay(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of the Delaunay triangulation: points enter one by one, and those triangles whose circle holds the new point are replaced by a fan.

    Points come from left to right, so triangles whose circle ends left of the last one are final and looked at no more.
    """
    n = len(x)
    if n < 3:
        return []
    mid_x, mid_y, span = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2, max(np.ptp(x), np.ptp(y), 1.0)
    px = np.concatenate([x, mid_x + span * np.array([-3e4, 3e4, 0.0])])
    py = np.concatenate([y, mid_y + span * np.array([-2e4, -2e4, 4e4])])
    tri, final = np.array([[n, n + 1, n + 2]]), []
    circle = circles(px, py, tri)
    for k, p in enumerate(np.lexsort((y, x))):
        if k % SWEEP == 0:
            passed = circle[:, 0] + np.sqrt(circle[:, 2]) * (1 + 1e-9) < px[p]
            final.append(tri[passed])
            tri, circle = tri[~passed], circle[~passed]
        inside = (px[p] - circle[:, 0]) ** 2 + (py[p] - circle[:, 1]) ** 2 < circle[:, 2] * (1 - 1e-12)
        hole = tri[inside]
        edges = np.sort(np.concatenate([hole[:, [0, 1]], hole[:, [1, 2]], hole[:, [0, 2]]]), axis=1)
        rim, times = np.unique(edges[:, 0] * (n + 3) + edges[:, 1], return_counts=True)
        rim = rim[times == 1]
        fan = np.column_stack([rim // (n + 3), rim % (n + 3), np.full(len(rim), p)])
        area = (px[fan[:, 1]] - px[fan[:, 0]]) * (py[p] - py[fan[:, 0]]) - (py[fan[:, 1]] - py[fan[:, 0]]) * (px[p] - px[fan[:, 0]])
        fan = fan[np.abs(area) > 1e-12 * span * span]
        tri, circle = np.concatenate([tri[~inside], fan]), np.concatenate([circle[~inside], circles(px, py, fan)])
    return [tuple(sorted(map(int, t))) for t in np.concatenate([*final, tri]) if t.max() < n]


#: Points of a surface for each tile that one task triangulates (with those of the tiles around it).
TILE_POINTS = 2000
CORNERS = [f"{c}{k}" for k in "abc" for c in "xyz"]


def corner_rows(s: pd.DataFrame, t: np.ndarray) -> dict[str, np.ndarray]:
    """Columns CORNERS of triangles over the points of s; corners in order of place, so that one triangle is one row however it was found."""
    x, y, z = (s[c].to_numpy(float) for c in "xyz")
    order = np.argsort(np.lexsort((y, x)))  # rank of each point
    t = np.take_along_axis(t, np.argsort(order[t], axis=1), axis=1) if len(t) else t
    return {f"{c}{k}": v[t[:, i]] for i, k in enumerate("abc") for c, v in (("x", x), ("y", y), ("z", z))}


def settled(x: np.ndarray, y: np.ndarray, t: np.ndarray, own: np.ndarray, halo: tuple[float, float, float, float], site: tuple[float, float, float, float]) -> np.ndarray:
    """Which own points have all their triangles, and the right ones, whatever points lie beyond the halo (x0, y0, x1, y1).

    A point does when its triangles close around it and each one's circle, as far as it lies within the site's box, lies in
    the halo.
    """
    c = circles(x, y, t)
    r = np.sqrt(c[:, 2]) * (1 + 1e-9)
    lo_x, hi_x, lo_y, hi_y = np.maximum(c[:, 0] - r, site[0]), np.minimum(c[:, 0] + r, site[2]), np.maximum(c[:, 1] - r, site[1]), np.minimum(c[:, 1] + r, site[3])
    safe = (lo_x >= halo[0]) & (hi_x <= halo[2]) & (lo_y >= halo[1]) & (hi_y <= halo[3])
    good = np.zeros(len(x), bool)
    good[np.unique(t)] = True
    good[np.unique(t[~safe])] = False
    edges = np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [0, 2]]]), axis=1)
    rim, times = np.unique(edges, axis=0, return_counts=True)
    good[np.unique(rim[times == 1])] = False
    return good & own


def triangles(samples: DataFrame) -> DataFrame:
    """site_id, surface, tri, and x, y, z of the corners a, b, c: the triangulation of each site's surface.

    Surfaces of many points are cut into tiles, and each tile is triangulated with the tiles around it. Points whose
    triangles no point farther off can change have theirs at once. The others, mostly near the surface's rim, are
    triangulated by themselves: those of their triangles without any point in the circle, found by a join with the tiles
    that the circle touches, are the rest of the triangulation. Where points lie on one circle, either diagonal may be
    taken. tri orders triangles of a surface and has no other meaning.
    """
    keys, kind = ["site_id", "surface"], samples.schema["site_id"].dataType.simpleString()
    p = kept(distinct_places(samples).select(*keys, F.col("x_ft").cast("double").alias("x"), F.col("y_ft").cast("double").alias("y"), F.col("z").cast("double").alias("z")), "places")
    box = p.groupBy(*keys).agg(F.min("x").alias("lo_x"), F.min("y").alias("lo_y"), F.max("x").alias("hi_x"), F.max("y").alias("hi_y"), F.greatest(F.lit(1), F.floor(F.sqrt(F.count(F.lit(1)) / TILE_POINTS))).cast("int").alias("k"))
    side = lambda v: F.when(F.col(f"hi_{v}") > F.col(f"lo_{v}"), F.least(F.col("k") - 1, F.floor((F.col(v) - F.col(f"lo_{v}")) / (F.col(f"hi_{v}") - F.col(f"lo_{v}")) * F.col("k")).cast("int"))).otherwise(0)
    tiled = p.join(box, keys).withColumn("ti", side("x")).withColumn("tj", side("y"))
    fields = ", ".join(f"{c} double" for c in CORNERS)

    def whole(s: pd.DataFrame) -> pd.DataFrame:
        t = np.array(sorted(delaunay(s.x.to_numpy(float), s.y.to_numpy(float))), int).reshape(-1, 3)
        return pd.DataFrame({"site_id": np.repeat(s.site_id.iloc[0], len(t)), "surface": np.repeat(s.surface.iloc[0], len(t)), **corner_rows(s, t)})

    def tile(s: pd.DataFrame) -> pd.DataFrame:
        x, y, own = s.x.to_numpy(float), s.y.to_numpy(float), s.own.to_numpy(bool)
        f = s.iloc[0]
        w, h = (f.hi_x - f.lo_x) / f.k, (f.hi_y - f.lo_y) / f.k
        halo = (f.lo_x + (f.to_i - 1) * w, f.lo_y + (f.to_j - 1) * h, f.lo_x + (f.to_i + 2) * w, f.lo_y + (f.to_j + 2) * h)
        t = np.array(sorted(delaunay(x, y)), int).reshape(-1, 3)
        good = settled(x, y, t, own, halo, (f.lo_x, f.lo_y, f.hi_x, f.hi_y)) if len(t) else np.zeros(len(s), bool)
        t = t[good[t].any(axis=1)] if len(t) else t
        rest = np.flatnonzero(own & ~good)
        rows = corner_rows(s, t)
        alone = {c: (s[c[0]].to_numpy(float)[rest] if c[1] == "a" else np.full(len(rest), np.nan)) for c in CORNERS}
        both = {c: np.concatenate([rows[c], alone[c]]) for c in CORNERS}
        return pd.DataFrame({"site_id": np.repeat(f.site_id, len(t) + len(rest)), "surface": np.repeat(f.surface, len(t) + len(rest)), **both, "open": np.repeat([False, True], [len(t), len(rest)])})

    schema = f"site_id {kind}, surface string, {fields}"
    small = tiled.where("k < 2").select(*p.columns).groupBy(*keys).applyInPandas(whole, schema)
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    around = tiled.where("k >= 2").withColumn("di", step).withColumn("dj", step).withColumn("to_i", F.col("ti") + F.col("di")).withColumn("to_j", F.col("tj") + F.col("dj"))
    around = around.where(F.col("to_i").between(0, F.col("k") - 1) & F.col("to_j").between(0, F.col("k") - 1)).withColumn("own", (F.col("di") == 0) & (F.col("dj") == 0))
    found = kept(around.groupBy(*keys, "to_i", "to_j").applyInPandas(tile, f"{schema}, open boolean"), "tiles")
    inner = found.where("NOT open").dropDuplicates([*keys, *[c for c in CORNERS if c[0] != "z"]]).drop("open")
    rest = found.where("open").select(*keys, F.col("xa").alias("x"), F.col("ya").alias("y"), F.col("za").alias("z")).groupBy(*keys).applyInPandas(whole, schema)
    return small.unionByName(inner).unionByName(empty_circles(kept(rest, "rim-triangles"), tiled.where("k >= 2"))).withColumn("tri", F.xxhash64(*[c for c in CORNERS if c[0] != "z"]))


def empty_circles(tris: DataFrame, tiled: DataFrame) -> DataFrame:
    """The triangles whose circle holds no point of their surface. tiled: points with their tile (ti, tj), the surface's box and k."""
    c, keys = F.col, ["site_id", "surface"]
    bx, by, cx, cy = c("xb") - c("xa"), c("yb") - c("ya"), c("xc") - c("xa"), c("yc") - c("ya")
    d = 2 * (bx * cy - by * cx)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    t = tris.join(tiled.select(*keys, "lo_x", "lo_y", "hi_x", "hi_y", "k").distinct(), keys).withColumn("mx", c("xa") + ux).withColumn("my", c("ya") + uy).withColumn("r2", ux * ux + uy * uy)
    for v, n in (("x", "ti"), ("y", "tj")):
        at = lambda w, v=v: F.greatest(F.lit(0), F.least(c("k") - 1, F.floor((w - c(f"lo_{v}")) / (c(f"hi_{v}") - c(f"lo_{v}")) * c("k")).cast("int")))
        lo, hi = F.greatest(c(f"lo_{v}"), c(f"m{v}") - F.sqrt("r2")), F.least(c(f"hi_{v}"), c(f"m{v}") + F.sqrt("r2"))
        t = t.withColumn(n, F.explode(F.when(c(f"hi_{v}") > c(f"lo_{v}"), F.sequence(at(lo), at(hi))).otherwise(F.array(F.lit(0)))))
    corners = [k for k in CORNERS if k[0] != "z"]
    inside = (c("x") - c("mx")) ** 2 + (c("y") - c("my")) ** 2 < c("r2") * (1 - 1e-9)
    corner = ((c("x") == c("xa")) & (c("y") == c("ya"))) | ((c("x") == c("xb")) & (c("y") == c("yb"))) | ((c("x") == c("xc")) & (c("y") == c("yc")))
    held = t.join(tiled.select(*keys, "ti", "tj", "x", "y"), [*keys, "ti", "tj"]).where(inside & ~corner).select(*keys, *corners).distinct()
    return tris.join(held, [*keys, *corners], "left_anti")


def on_triangles(tris: DataFrame, extent: DataFrame, grid_n: int) -> DataFrame:
    """site_id, surface, i, j, z at the grid nodes inside triangles: each triangle names the nodes of its box, no join with cells is needed."""
    c = F.col
    t = tris.join(extent, "site_id")
    for v, step, n in (("x", "dx", "j"), ("y", "dy", "i")):
        lo, hi = F.least(*[c(f"{v}{k}") for k in "abc"]), F.greatest(*[c(f"{v}{k}") for k in "abc"])
        first = F.greatest(F.lit(0), F.ceil((lo - c(f"{v}0")) / c(step) - 1e-9).cast("int"))
        last = F.least(F.lit(grid_n - 1), F.floor((hi - c(f"{v}0")) / c(step) + 1e-9).cast("int"))
        t = t.withColumn(n, F.explode(F.when(first <= last, F.sequence(first, last))))
    t = t.withColumn("x", c("x0") + c("j") * c("dx")).withColumn("y", c("y0") + c("i") * c("dy"))
    det = (c("yb") - c("yc")) * (c("xa") - c("xc")) + (c("xc") - c("xb")) * (c("ya") - c("yc"))
    u = ((c("yb") - c("yc")) * (c("x") - c("xc")) + (c("xc") - c("xb")) * (c("y") - c("yc"))) / det
    v = ((c("yc") - c("ya")) * (c("x") - c("xc")) + (c("xa") - c("xc")) * (c("y") - c("yc"))) / det
    t = t.withColumn("u", u).withColumn("v", v).where("u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9")
    z = c("u") * c("za") + c("v") * c("zb") + (1 - c("u") - c("v")) * c("zc")
    return t.groupBy("site_id", "surface", "i", "j").agg(F.min_by(z, "tri").alias("z"))


def interpolate(samples: DataFrame, extent: DataFrame, grid_n: int, method: str = "linear") -> DataFrame:
    """site_id, surface, i, j, z at every node for every surface that a site has. linear: on triangles, nearest outside of them."""
    nodes = cells(extent, grid_n).join(samples.select("site_id", "surface").distinct(), "site_id").select("site_id", "surface", "i", "j", "x", "y")
    points = distinct_places(samples).select("site_id", "surface", F.col("x_ft").cast("double").alias("px"), F.col("y_ft").cast("double").alias("py"), "seq", "z")
    keys = ["site_id", "surface"]
    if method == "nearest":
        return nearest(nodes, points, keys).select(*keys, "i", "j", "z")
    places = points.select(*keys, F.col("px").alias("x"), F.col("py").alias("y"), F.col("z").cast("double").alias("z"), F.col("seq").cast("long").alias("seq"))
    return facets.on_grid(places, extent, grid_n)


def paired(extent: DataFrame, grid_n: int, surfaces: DataFrame, samples: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """site_id, i, j, x, y, existing, proposed, cell_ft of every node.

    Sites with fewer than least_points proposed samples have no surface at all; with fewer existing ones, existing is
    proposed less fallback_drop_ft everywhere. Where existing alone is unknown, it is proposed less unknown_drop_ft.
    """
    both = surfaces.groupBy("site_id", "i", "j").agg(*[F.max(F.when(F.col("surface") == s, F.col("z"))).alias(s) for s in ("existing", "proposed")])
    n = samples.groupBy("site_id").agg(*[F.count_if(F.col("surface") == s).alias(f"n_{s}") for s in ("existing", "proposed")])
    g = cells(extent, grid_n).join(both, ["site_id", "i", "j"], "left").join(n, "site_id")
    proposed = F.when(F.col("n_proposed") >= params.least_points, F.col("proposed"))
    existing = F.when(F.col("n_existing") < params.least_points, proposed - params.fallback_drop_ft).otherwise(F.coalesce("existing", proposed - params.unknown_drop_ft))
    return g.select("site_id", "i", "j", "x", "y", F.when(F.col("n_proposed") >= params.least_points, existing).alias("existing"), proposed.alias("proposed"), "cell_ft")


def build_surfaces(samples: DataFrame, grid_n: int, params: Params = DEFAULTS, method: str = "linear", pad_share: float | None = None) -> DataFrame:
    """Both surfaces of each site on one grid, from samples (SAMPLES, in feet)."""
    extent = kept(extents(samples, grid_n, params.pad_share if pad_share is None else pad_share), "extents")
    return paired(extent, grid_n, interpolate(samples, extent, grid_n, method), samples, params)


def alignment(frames: DataFrame) -> Column:
    """Factor from an existing sheet's feet to the proposed sheet's: the mean of the size ratios known, within 0.55 .. 1.8.

    frames has ew, eh and pw, ph: the property's width and height on the existing and on the proposed sheet.
    """
    ratio = lambda p, e: F.when((F.col(e) > 1) & (F.col(p) > 1), F.col(p) / F.col(e))
    known = F.array_compact(F.array(ratio("pw", "ew"), ratio("ph", "eh")))
    mean = F.aggregate(known, F.lit(0.0), lambda s, r: s + r) / F.size(known)
    return F.greatest(F.lit(0.55), F.least(F.lit(1.8), F.when(F.size(known) > 0, mean).otherwise(1.0)))


def fuse_samples(proposed_sheet: DataFrame, existing_sheet: DataFrame, frames: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Samples of both sheets in the proposed sheet's frame, clipped to the property. Sheets: SAMPLES; frames: site_id, pw, ph, ew, eh.

    Only the existing sheet's samples are scaled. Clipping of proposed samples is undone for sites it would leave with
    fewer than least_points.
    """
    f = frames.select("site_id", F.greatest(F.col("pw") * 0.55, F.lit(40.0)).alias("half_w"), F.greatest(F.col("ph") * 0.55, F.lit(40.0)).alias("half_h"), alignment(frames).alias("s"))
    moved = existing_sheet.where("surface = 'existing'").join(f, "site_id").withColumn("x_ft", F.col("x_ft") * F.col("s")).withColumn("y_ft", F.col("y_ft") * F.col("s"))
    own = proposed_sheet.join(f, "site_id")
    inside = lambda k: (F.abs(F.col("x_ft")) <= F.col("half_w") * k) & (F.abs(F.col("y_ft")) <= F.col("half_h") * k)
    existing = moved.unionByName(own.where("surface = 'existing'")).where(inside(1.25)).select(*SAMPLES)
    proposed = own.where("surface = 'proposed'").withColumn("inside", inside(1.15))
    enough = proposed.groupBy("site_id").agg((F.count_if("inside") >= params.least_points).alias("enough"))
    return existing.unionByName(proposed.join(enough, "site_id").where("inside OR NOT enough").select(*SAMPLES))


def fuse_surfaces(proposed_sheet: DataFrame, existing_sheet: DataFrame, frames: DataFrame, grid_n: int, params: Params = DEFAULTS, method: str = "linear") -> DataFrame:
    """Both surfaces on one grid from two sheets, without the nodes outside the property's ellipse."""
    samples = kept(fuse_samples(proposed_sheet, existing_sheet, frames, params), "fused-samples")
    grid = build_surfaces(samples, grid_n, params, method, params.fused_pad_share).join(frames.select("site_id", F.greatest(F.col("pw") * 0.55, F.lit(40.0)).alias("half_w"), F.greatest(F.col("ph") * 0.55, F.lit(40.0)).alias("half_h")), "site_id")
    within = (F.col("x") / F.col("half_w")) ** 2 + (F.col("y") / F.col("half_h")) ** 2 <= 1.05
    return grid.select("site_id", "i", "j", "x", "y", *[F.when(within, F.col(c)).alias(c) for c in ("existing", "proposed")], "cell_ft")
