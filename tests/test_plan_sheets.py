"""Literal cases of the plan-sheet operators."""

from __future__ import annotations

import itertools
import json
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracut.functions import geometry as G
from terracut.functions import text as T
from terracut.operators import alongside, associate, elevations, facets, layers, layout, legend, polylines, raster, scales, site, spatial, strokes, styles, surfaces, volumes
from terracut.params import DEFAULTS
from terracut.plans import cutfill
from terracut.plans.registry import QUERIES
from terracut.sources import tables
from terracut.streaming import arrivals

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_elevation_readings(spark):
    cases = [
        ("1010.25", "", "proposed", (1010.25, "spot", 0.8)), ("1010.25", "x ME y", "proposed", (1010.25, "existing_match", 0.95)), ("1010", None, "existing", (1010.0, "existing_match", 0.6)),
        ("1010", "", "proposed", None), ("1010", "TC", "proposed", (1010.0, "weak", 0.55)), ("799.99", "", "auto", None), ("1200.01", "", "auto", None), ("800.0", "", "auto", (800.0, "spot", 0.8)),
        ("1200.0", "", "auto", (1200.0, "spot", 0.8)), ("\t el. 1,010.5 ", "", "auto", (1010.5, "spot", 0.95)), ("ELEV 950", "", "proposed", (950.0, "weak", 0.55)), ("12", "TC", "existing", None), (None, "TC", "existing", None),
        ("1300.5", "TC", "existing", None), ("MEADOW 900", "MEADOW", "proposed", None),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, c string, role string").withColumn("e", T.elevation(F.col("t"), F.col("c"), F.col("role")))
    assert [tuple(r.e) if r.e else None for r in rows.orderBy("i").collect()] == [c[3] for c in cases]


def test_scales(spark):
    cases = [('SCALE: 1" = 20 ft', (20.0, 0.95)), ("1\" = 20'", (20.0, 0.85)), ("1\" = 500'", None), ("no note", None), ("scale 1=30.5 feet", (30.5, 0.95)), ("SCALE: 1\" = 900' or 1\" = 40'", None), (None, None)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").withColumn("s", T.scale(F.col("t")))
    assert [tuple(r.s) if r.s else None for r in rows.orderBy("i").collect()] == [c[1] for c in cases]


def test_scale_cascade(spark):
    spans = spark.createDataFrame([
        ("a", 1, 'SCALE: 1" =', 0.0, 0.0), ("a", 2, "30'", 50.0, 10.0), ("a", 3, "60'", 900.0, 900.0),
        ("b", 1, "1\" = 40'", 0.0, 0.0), ("b", 2, 'SCALE: 1" = 10 ft', 500.0, 0.0),
        ("c", 1, "nothing", 0.0, 0.0),
        ("d", 1, "SCALE:", 0.0, 0.0), ("d", 2, "1\" = 25 feet", 900.0, 0.0), ("e", 1, "scale: 1", 0.0, 0.0), ("e", 2, "= 50 ft", 900.0, 900.0),
    ], "sheet_id string, seq int, text string, x double, y double")
    sheets = spark.createDataFrame([(s,) for s in "abcde"], "sheet_id string")
    got = dict((r.sheet_id, (r.ft_per_inch, r.source, r.confidence)) for r in scales.detect_scales(spans, sheets).collect())
    assert got == {"a": (30.0, "pdf_nearby", 0.95), "b": (40.0, "pdf_span", 0.85), "c": (10.0, "default", 0.2), "d": (25.0, "pdf_span", 0.85), "e": (50.0, "pdf_blob", 0.95)}


CALL = "sheet_id string, seq long, text string, value_ft double, x double, y double, source string, confidence double, kind string"


def callouts(spark, rows):
    return spark.createDataFrame([("s", i, "t", float(v), float(x), float(y), "pdf_text", float(c), "spot") for i, (v, x, y, c) in enumerate(rows)], CALL)


def test_floor_levels_and_outliers(spark):
    five, four = [(900.125, 20 * i, 0, 0.8) for i in range(5)], [(900.1, 20 * i, 0, 0.8) for i in range(4)]
    assert values(elevations.collapse_pad_levels(callouts(spark, five)), "x", "kind", "confidence") == [(40.0, "ffe", 0.7)]
    assert len(elevations.collapse_pad_levels(callouts(spark, four)).collect()) == 4
    near = [(1000 + i, 0, 0, 1) for i in range(3)]
    assert elevations.drop_outliers(callouts(spark, [*near, (800, 0, 0, 1)])).count() == 4
    assert elevations.drop_outliers(callouts(spark, [*near, (1003, 0, 0, 1), (800, 0, 0, 1)])).count() == 4


def greedy(rows):
    kept = []
    for i, (v, x, y, c) in sorted(enumerate(rows), key=lambda r: -r[1][3]):
        if not any(abs(x - a) < 12 and abs(y - b) < 12 and abs(v - u) < 0.05 for _, (u, a, b, _) in kept):
            kept.append((i, (v, x, y, c)))
    return {i for i, _ in kept}


def test_dedupe_is_the_greedy_one(spark):
    assert {r.seq for r in elevations.dedupe(callouts(spark, [(900, 0, 0, 0.9), (900, 8, 0, 0.8), (900, 16, 0, 0.7)])).collect()} == {0, 2}
    rng = np.random.default_rng(1)
    rows = [(float(rng.choice([900.0, 900.03, 901.0])), float(x), float(y), float(c)) for x, y, c in zip(rng.integers(0, 200, 150), rng.integers(0, 60, 150), rng.choice([0.6, 0.8, 0.95], 150), strict=True)]
    assert {r.seq for r in elevations.dedupe(callouts(spark, rows)).collect()} == greedy(rows)


@pytest.mark.parametrize("piece", [1, 5, 40])
def test_dense_pieces_go_by_rounds(spark, monkeypatch, piece):
    monkeypatch.setattr(elevations, "PIECE", piece)
    rng = np.random.default_rng(piece)
    rows = [(float(rng.choice([900.0, 900.03, 900.06])), float(x), float(y), float(c)) for x, y, c in zip(rng.integers(-40, 60, 250), rng.integers(0, 30, 250), rng.choice([0.6, 0.8, 0.95], 250), strict=True)]
    rows += [(900.0, 500.0, 500.0, 0.7)] * 60 + [(900.0, 600.0 + 11 * i, 0.0, 0.9 - i / 100) for i in range(20)]
    assert {r.seq for r in elevations.dedupe(callouts(spark, rows)).collect()} == greedy(rows)


def test_many_callouts_at_one_place(spark):
    """A piece of 20,000 callouts takes rounds over cells, not a task."""
    rows = spark.range(20_000).select(F.lit("s").alias("sheet_id"), F.col("id").alias("seq"), F.lit("t").alias("text"), F.lit(900.0).alias("value_ft"), (F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.lit("pdf_text").alias("source"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("confidence"), F.lit("spot").alias("kind"))
    got = {r.seq for r in elevations.dedupe(rows).collect()}
    every = {r.seq: (r.value_ft, r.x, r.y, r.confidence) for r in rows.collect()}
    assert got == greedy([every[i] for i in range(20_000)])


def test_association_preference(spark):
    points = spark.createDataFrame([("s", 1, 0, -50.0, 10.0), ("s", 1, 1, 50.0, 10.0), ("s", 2, 0, 0.0, 100.0), ("s", 3, 0, 0.0, -30.0), ("t", 1, 0, 3.0, 4.0)], "sheet_id string, poly_seq int, pos int, x double, y double")
    kinds = spark.createDataFrame([("s", 1, "existing"), ("s", 2, "proposed"), ("s", 3, "structure"), ("t", 1, "structure")], "sheet_id string, poly_seq int, kind string")
    e = spark.createDataFrame([("s", 1, 0.0, 0.0, "spot"), ("s", 2, 0.0, 0.0, "existing_match"), ("s", 3, 0.0, 0.0, "weak"), ("t", 4, 0.0, 0.0, "spot")], "sheet_id string, seq long, x double, y double, kind string")
    got = {r.seq: (r.poly_seq, r.foot_x, r.foot_y, r.distance) for r in associate.associate(e, points, kinds).collect()}
    # The only proposed contour is too far for the spot, and no other contour stands in for it.
    assert got == {2: (1, 0.0, 10.0, 10.0), 3: (1, 0.0, 10.0, 10.0), 4: (1, 3.0, 4.0, 5.0)}


def test_associations_of_dense_sheets(spark, monkeypatch):
    """Tiles, chunks and batches find what comparing all callouts with all steps finds; equal to nine digits is a tie."""
    monkeypatch.setattr(associate, "TILE_CALLOUTS", 40)
    monkeypatch.setattr(associate, "CHUNK_STEPS", 100)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 200, (2, 150)).astype(float)
    p = np.concatenate([rng.integers(0, 200, (700, 2)), rng.random((300, 2)) * 200]).astype(float)
    kind = ["existing", "proposed", "structure", "topo"]
    points = [("s", i // 2, i % 2, *map(float, v)) for i, v in enumerate(p)] + [("s", 900 + i // 2, i % 2, *map(float, v)) for i, v in enumerate(p[:100])] + [("s", 1000, 0, float("nan"), 1.0), ("s", 1000, 1, 5.0, 1.0)]
    calls = [("s", i, a, b, ("spot", "existing_match", "weak")[i % 3]) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))] + [("s", 500, None, 1.0, "weak"), ("s", 501, float("inf"), 1.0, "weak")]
    points += [("t", 5, 0, 0.0, 4e-12), ("t", 5, 1, 9.0, 4e-12), ("t", 7, 0, 0.0, 3e-12), ("t", 7, 1, 9.0, 3e-12)]
    calls += [("t", 1, 4.0, 0.0, "weak")]
    lines = {(r[0], r[1]): kind[r[1] % 4] for r in points}
    e = spark.createDataFrame(calls, "sheet_id string, seq long, x double, y double, kind string")
    pts = spark.createDataFrame(points, "sheet_id string, poly_seq int, pos int, x double, y double")
    kinds = spark.createDataFrame([(*k, v) for k, v in lines.items()], "sheet_id string, poly_seq int, kind string")
    got = {(r.sheet_id, r.seq): (r.poly_seq, round(r.distance, 9)) for r in associate.associate(e, pts, kinds, 6.0).collect()}
    want = {}
    for sheet, seq, a, b, k in calls[:150]:
        for (own, n, _, *u), (_, m, _, *v) in zip(points, points[1:], strict=False):
            style = {"spot": ["proposed"], "existing_match": ["existing"], "weak": ["existing", "proposed", "topo"]}[k]
            if own == sheet and n == m and n < 1000 and lines[(sheet, n)] in style:
                far = float(associate.feet(np.array([a]), np.array([b]), np.array([[u[0]], [u[1]], [v[0]], [v[1]]]))[2][0])
                if far <= 6 and ((sheet, seq) not in want or (round(far, 9), n) < want[(sheet, seq)][::-1]):
                    want[(sheet, seq)] = (n, round(far, 9))
    assert got.pop(("t", 1)) == (5, 0.0)
    assert got == want


def test_redundant_polylines_without_pairs_as_rows(spark, monkeypatch):
    """Regions, batches and groups of samples find what counting all pairs finds, and short lines take no join."""
    monkeypatch.setattr(alongside, "BUCKET_LINES", 200)
    monkeypatch.setattr(alongside, "FIRST_BATCH", 16)
    rng = np.random.default_rng(8)
    rows = []
    for line in range(260):
        n = [1, 2, 3, 4, 5, 6, 7, 25][line % 8]
        a = rng.integers(0, 300, (n, 2))
        if line % 3 == 0 and line > 5:  # beside another one, in part
            other = [r[3:] for r in rows if r[1] == line - 6]
            a[: n // 2 + 1] = [np.array(other[i % len(other)]) + rng.integers(-6, 7, 2) for i in range(n // 2 + 1)]
        rows += [("st"[line % 2], line, i, *map(float, v)) for i, v in enumerate(a)]
    rows += [("s", 900, i, float("nan") if i == 1 else 500.0, 500.0) for i in range(3)] + [("s", 901, i, 505.0, 500.0) for i in range(2)]
    rows += [("c", i, j, 7.0 * j, 0.0) for i in range(2000) for j in range(5)]
    schema = "sheet_id string, poly_seq int, pos int, x double, y double"
    points = spark.createDataFrame(rows, schema)
    share = F.col("share") >= DEFAULTS.redundant_share
    want = {(r.sheet_id, r.poly_seq) for r in polylines.near_shares(points.where("sheet_id <> 'c'"), DEFAULTS).where(share).select(*polylines.KEY).collect()}
    long_one = spark.createDataFrame([("u", 1, i, 3.0 * i, 0.0) for i in range(200)] + [("u", 2, i, 3.0 * i, 4.0) for i in range(60)] + [("u", 3, i, 90.0 * i, 300.0 * i) for i in range(5)], schema)
    assert {r.poly_seq for r in polylines.redundant(long_one).collect()} == {2}
    monkeypatch.setattr(polylines, "near_shares", None)
    got = [(r.sheet_id, r.poly_seq) for r in polylines.redundant(points).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {("c", i) for i in range(2000)} and 60 < len(want) < 200


def test_redundant_polylines_go_once_to_a_region(spark, monkeypatch):
    """A line goes to the regions that it has points in or near, not to all pairs of them, and many lines travel in one row."""
    monkeypatch.setattr(alongside, "BUCKET_LINES", 400)
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([("s", line, i, *map(float, v)) for line in range(1500) for i, v in enumerate(rng.integers(0, 1000, (7, 2)))], "sheet_id string, poly_seq int, pos int, x double, y double")
    share = F.col("share") >= DEFAULTS.redundant_share
    want = {r.poly_seq for r in polylines.near_shares(points, DEFAULTS).where(share).collect()}
    assert {r.poly_seq for r in polylines.redundant(points).collect()} == want
    found = alongside.beside_short_ones(alongside.lines_of(points, DEFAULTS), DEFAULTS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Generate explode") == 1  # the box alone takes points one by one
    assert alongside.packed(np.array([1.0, 2.5])) == np.array([1.0, 2.5], np.float32).tobytes() and len(alongside.packed(np.array([0.1]))) == 8


def test_foot_on_segment(spark):
    rows = spark.createDataFrame([(0.0, 5.0, -10.0, 0.0, 10.0, 0.0), (0.0, 5.0, 20.0, 0.0, 30.0, 0.0), (0.0, 5.0, 3.0, 1.0, 3.0, 1.0)], "x double, y double, x1 double, y1 double, x2 double, y2 double")
    fx, fy = G.foot_on_segment(*[F.col(c) for c in rows.columns])
    assert values(rows.select(fx.alias("fx"), fy.alias("fy")), "fx", "fy") == [(0.0, 0.0), (20.0, 0.0), (3.0, 1.0)]


def grid(spark, deltas, cell=3.0):
    return spark.createDataFrame([("s", 100.0, None if d is None else 100.0 + d, cell) for d in deltas], "site_id string, existing double, proposed double, cell_ft double")


def test_cut_fill(spark):
    r = volumes.cut_fill(grid(spark, [1.0, -2.0, 0.0, float("nan")]), ["site_id"]).first()
    assert (r.fill_cy, r.cut_cy, r.net_cy, r.cell_count, r.ok) == (9 / 27, 18 / 27, -9 / 27, 3, True)
    r = volumes.cut_fill(grid(spark, [None, float("nan")]), ["site_id"]).first()
    assert (r.fill_cy, r.cut_cy, r.ok, r.message, r.cell_count) == (0.0, 0.0, False, volumes.NO_GRID, 0)
    apart = spark.createDataFrame([("s", None, 1.0, 1.0), ("s", 1.0, None, 1.0)], "site_id string, existing double, proposed double, cell_ft double")
    assert volumes.cut_fill(apart, ["site_id"]).first().message == volumes.NO_CELLS


@pytest.mark.parametrize(("truth", "pred", "want"), [((0.0, 100.0), (5.0, 104.0), (None, 4.0, True)), ((0.0, 0.0), (1.0, 1.0), (None, None, False)), ((100.0, 100.0), (94.0, 101.0), (6.0, 1.0, False))])
def test_scores(spark, truth, pred, want):
    both = [spark.createDataFrame([("s", *v)], "site_id string, cut_cy double, fill_cy double") for v in (pred, truth)]
    r = volumes.evaluate(*both, ["site_id"]).first()
    assert (r.cut_pct_error, r.fill_pct_error, r.within_tolerance) == want
    assert volumes.evaluate(both[0], both[1].limit(0), ["site_id"]).first().within_tolerance is None


def test_truth_report(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"job": "j", "cut_cy": 30.0, "fill_cy": 12.0, "regions": {"a": {"cut_cy": 10, "fill_cy": 5}, "b": {"cut_cy": 20, "fill_cy": 7}}}, indent=1))
    r = volumes.region_totals(tables.read_truth(spark, str(tmp_path))).first()
    assert (r.regions_cut_cy, r.regions_fill_cy, r.regions) == (30.0, 12.0, 2)


def runs(spark, sizes):
    rows, pos = [], 0
    for k, n in enumerate(sizes):
        for ink, m in ((True, n), (False, 2)) if k < len(sizes) - 1 else ((True, n),):
            for _ in range(m):
                rows.append((1, pos, 0 if ink else 255))
                pos += 1
    return spark.createDataFrame(rows, "stroke_id int, pos int, gray int")


@pytest.mark.parametrize(("sizes", "want"), [([8, 2, 2, 8, 2, 2], "dashed"), ([10, 4, 4, 10, 10], "dashed"), ([16, 6, 3, 3, 6], "dash_dot_dot"), ([40], "solid"), ([30, 30], "solid"), ([5, 5, 5], "dashed")])
def test_signatures(spark, sizes, want):
    assert styles.profiles(runs(spark, sizes), ["stroke_id"]).first().pattern == want


def test_refined_templates(spark):
    seen = spark.createDataFrame([("proposed_contour", "solid", 0.5, 0.3, 190.0)], "name string, pattern string, ink_ratio double, trans_rate double, mean_gray double")
    r = {x.name: x for x in styles.refined(styles.templates(spark), seen).collect()}
    p = r["proposed_contour"]
    assert (round(p.ink_lo, 6), p.ink_hi, p.tr_lo, round(p.tr_hi, 6), p.gray_max) == (0.3, 1.0, 0.0, 0.45, 225.0)
    assert (r["existing_contour"].ink_lo, r["existing_contour"].gray_max) == (0.25, 200.0)


def test_strides_and_boxes(spark):
    rows = spark.range(20).select(F.lit("s").alias("sheet_id"), F.lit(1).alias("poly_seq"), F.col("id").cast("int").alias("pos"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    assert sorted(r.pos for r in polylines.strided(rows, 6).collect()) == [0, 3, 6, 9, 12, 15, 18]
    boxes = spark.createDataFrame([((10.0, 10.0, 5.0, 5.0),), ((5.0, 5.0, 5.0, 9.0),), ((-3.0, 2.5, 300.0, 9.9),)], f"b {BOX}")
    assert [tuple(r[0]) for r in boxes.select(G.clamp_bbox(F.col("b"), F.lit(100), F.lit(100))).collect()] == [(5, 5, 10, 10), (5, 5, 6, 9), (0, 2, 100, 9)]
    turned = spark.createDataFrame([((1.0, 2.0, 3.0, 5.0),)], f"b {BOX}").select(G.rotated_bbox(F.col("b"), [F.lit(float(v)) for v in (0, 1, -1, 0, 10, 0)], F.lit(2.0)).alias("r")).first().r
    assert tuple(turned) == (10.0, 2.0, 16.0, 6.0)
    angles = spark.createDataFrame([(1.0, 179.0)], "a double, b double")
    assert angles.select(G.axial_difference(F.col("a"), F.col("b"))).first()[0] == 2.0


def site_samples(spark, points):
    return spark.createDataFrame([("s", surface, i, float(x), float(y), float(z)) for i, (surface, x, y, z) in enumerate(points)], "site_id string, surface string, seq long, x_ft double, y_ft double, z double")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=3, max_size=30, unique=True))
def test_triangles_cover_the_hull_without_points_in_circles(points):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    area = 0.0
    for a, b, c in surfaces.delaunay(x, y):
        twice = abs((x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a]))
        area += twice / 2
        d = 2 * ((x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a]))
        ux = ((y[c] - y[a]) * ((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2) - (y[b] - y[a]) * ((x[c] - x[a]) ** 2 + (y[c] - y[a]) ** 2)) / d
        uy = ((x[b] - x[a]) * ((x[c] - x[a]) ** 2 + (y[c] - y[a]) ** 2) - (x[c] - x[a]) * ((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2)) / d
        assert ((x - x[a] - ux) ** 2 + (y - y[a] - uy) ** 2 >= (ux * ux + uy * uy) * (1 - 1e-6)).all()
    order = sorted(set(points))
    hull: list = []
    for chain in (order, order[::-1]):
        side: list = []
        for p in chain:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        hull += side[:-1]
    whole = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))) / 2
    assert abs(area - whole) < 1e-6 * max(1, whole) + 0.02 * whole


def test_tiles_make_the_same_triangles(spark, monkeypatch):
    monkeypatch.setattr(surfaces, "TILE_POINTS", 12)
    rng = np.random.default_rng(9)
    sites = {"even": rng.uniform(0, 1000, (400, 2)), "long": rng.uniform(0, 1, (300, 2)) * [5000, 40], "clusters": np.concatenate([rng.normal(m, 8, (90, 2)) for m in ((0, 0), (500, 30), (90, 800))]), "ring": np.stack([np.cos(a := rng.uniform(0, 6.3, 200)) * 100, np.sin(a) * 70], axis=1) + rng.normal(0, 1, (200, 2)), "few": rng.uniform(0, 9, (9, 2))}
    rows = [(k, "proposed", i, float(x), float(y), float(i)) for k, v in sites.items() for i, (x, y) in enumerate(v)]
    rows += [("line", "proposed", i, float(i), 5.0, 1.0) for i in range(60)]
    got: dict = {}
    for r in surfaces.triangles(spark.createDataFrame(rows, "site_id string, surface string, seq long, x_ft double, y_ft double, z double")).collect():
        got.setdefault(r.site_id, []).append(frozenset((int(r.za), int(r.zb), int(r.zc))))
    assert "line" not in got
    for k, v in sites.items():
        want = {frozenset(t) for t in surfaces.delaunay(v[:, 0], v[:, 1])}
        assert len(got[k]) == len(set(got[k])) and set(got[k]) == want, k


def test_surface_of_a_plane(spark):
    rng = np.random.default_rng(0)
    points = [("proposed", *p, 900 + 2 * p[0] - p[1]) for p in rng.uniform(0, 100, (40, 2))] + [("existing", *p, 890.0) for p in rng.uniform(0, 100, (10, 2))]
    g = surfaces.build_surfaces(site_samples(spark, points), 12)
    tin = surfaces.on_triangles(surfaces.triangles(site_samples(spark, points)), surfaces.extents(site_samples(spark, points), 12, 0.05), 12).where("surface = 'proposed'")
    both = tin.join(g.select("i", "j", "x", "y", "existing", "proposed"), ["i", "j"]).collect()
    assert len(both) > 50
    assert all(abs(r.z - (900 + 2 * r.x - r.y)) < 1e-6 and abs(r.proposed - r.z) < 1e-9 and abs(r.existing - 890) < 1e-9 for r in both)
    assert g.count() == 144 and g.where("proposed IS NULL OR existing IS NULL").count() == 0


def brute_heights(v, z, nodes):
    """On the triangle around each node, the lowest of several on one circle, or of the nearest point (the first among equals)."""
    x, y = v[:, 0], v[:, 1]
    out = np.full(len(nodes), np.nan)
    for t in itertools.combinations(range(len(x)), 3):
        (ax, ay), (bx, by), (cx, cy) = v[list(t)]
        d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        if d == 0:
            continue
        ux, uy = ((cy - ay) * ((bx - ax) ** 2 + (by - ay) ** 2) - (by - ay) * ((cx - ax) ** 2 + (cy - ay) ** 2)) / d, ((bx - ax) * ((cx - ax) ** 2 + (cy - ay) ** 2) - (cx - ax) * ((bx - ax) ** 2 + (by - ay) ** 2)) / d
        if ((x - ax - ux) ** 2 + (y - ay - uy) ** 2 < (ux * ux + uy * uy) * (1 - 1e-9)).any():
            continue
        u = ((by - cy) * (nodes[:, 0] - cx) + (cx - bx) * (nodes[:, 1] - cy)) / (d / 2)
        w = ((cy - ay) * (nodes[:, 0] - cx) + (ax - cx) * (nodes[:, 1] - cy)) / (d / 2)
        on = (u >= -1e-9) & (w >= -1e-9) & (u + w <= 1 + 1e-9)
        out[on] = np.fmin(out[on], (u * z[t[0]] + w * z[t[1]] + (1 - u - w) * z[t[2]])[on])
    for k in np.flatnonzero(np.isnan(out)):
        out[k] = z[np.argmin((x - nodes[k, 0]) ** 2 + (y - nodes[k, 1]) ** 2)]
    return out


@pytest.mark.parametrize("points", [6, 1 << 15])
def test_nodes_find_their_triangles(spark, monkeypatch, points):
    """Tiles and rounds give what all triangles with empty circles give; no triangulation is made."""
    monkeypatch.setattr(facets, "TILE_POINTS", points)
    monkeypatch.setattr(surfaces, "delaunay", None)
    rng = np.random.default_rng(12)
    sites = {"even": rng.uniform(0, 1000, (90, 2)), "long": rng.uniform(0, 1, (60, 2)) * [5000, 40], "clusters": np.concatenate([rng.normal(m, 8, (25, 2)) for m in ((0, 0), (500, 30), (90, 800))]), "few": rng.uniform(0, 9, (4, 2)), "line": np.stack([np.arange(60.0)] * 2, axis=1)}
    sites["ring"] = np.stack([np.cos(a := rng.uniform(0, 6.3, 60)) * 100, np.sin(a) * 70], axis=1) + rng.normal(0, 1, (60, 2))
    sites["lattice"] = np.stack([v.ravel() for v in np.meshgrid(np.arange(8.0), np.arange(9.0))], axis=1)[rng.permutation(72)[:60]]
    z = {k: rng.uniform(0, 100, len(v)) for k, v in sites.items()}
    samples = spark.createDataFrame([(k, "proposed", i, float(x), float(y), float(z[k][i])) for k, v in sites.items() for i, (x, y) in enumerate(v)], "site_id string, surface string, seq long, x_ft double, y_ft double, z double")
    extent = surfaces.extents(samples, 15, 0.05)
    got: dict = {}
    for r in surfaces.interpolate(samples, extent, 15).collect():
        got.setdefault(r.site_id, {})[r.i, r.j] = r.z
    for e in extent.collect():
        nodes = np.array([(e.x0 + j * e.dx, e.y0 + i * e.dy) for i in range(15) for j in range(15)])
        want = brute_heights(sites[e.site_id], z[e.site_id], nodes)
        assert len(got[e.site_id]) == 225
        assert np.abs(np.array([got[e.site_id][i, j] for i in range(15) for j in range(15)]) - want).max() < 1e-6, e.site_id


def test_few_samples(spark):
    three = [("proposed", 0, 0, 900), ("proposed", 10, 0, 900), ("proposed", 0, 10, 900)]
    v = volumes.cut_fill(surfaces.build_surfaces(site_samples(spark, [*three, ("existing", 1, 1, 1)]), 5), ["site_id"]).first()
    assert v.cut_cy == 0 and abs(v.fill_cy - 0.25 * 25 * (11 / 4) ** 2 / 27) < 1e-9
    assert not volumes.cut_fill(surfaces.build_surfaces(site_samples(spark, three[:2]), 5), ["site_id"]).first().ok
    e = site_samples(spark, [("existing", 0, 0, 900), ("existing", 10, 0, 900), ("existing", 0, 10, 900)])
    assert surfaces.with_fallback(e, e.drop("surface")).where("surface = 'proposed'").count() == 3


def test_alignment(spark):
    f = spark.createDataFrame([(100.0, 100.0, 200.0, 100.0), (100.0, 100.0, 0.5, 0.5), (1000.0, 1000.0, 10.0, 10.0)], "pw double, ph double, ew double, eh double")
    assert [r[0] for r in f.select(surfaces.alignment(f)).collect()] == [0.75, 1.0, 1.8]


def test_property_chain(spark):
    rows, x, i = [], 0.0, 0
    for _ in range(6):
        for n in (30.0, 6.0, 6.0):
            rows.append(("s", i, x, 100.0, x + n, 100.0, 0.5, 0.0))
            x, i = x + n + 5, i + 1
    rows += [("s", 100 + k, 0.0, 300.0 + 40 * k, 5.0, 300.0 + 40 * k, 0.5, 0.0) for k in range(5)] + [("s", 200 + k, 50.0 * k, 500.0, 50.0 * k + 45, 500.0, 2.0, 0.1) for k in range(4)]
    s = strokes.measured(spark.createDataFrame(rows, "sheet_id string, seq long, x1 double, y1 double, x2 double, y2 double, w double, color0 double"))
    (p,) = strokes.property_strokes(s).collect()
    assert p.members == 18 and abs(p.length - (x - 5)) < 1
    (b,) = strokes.building_strokes(s).collect()
    assert b.members == 4 and abs(b.length - 195) < 1e-6
    dense = strokes.densified(strokes.building_strokes(s)).first().points
    assert len(dense) == 19 and dense[0].x == b.x1 and dense[-1].x == b.x2


def test_hull_and_rooms(spark):
    points = spark.createDataFrame([("s", float(x), float(y)) for x in range(5) for y in range(5)], "sheet_id string, x double, y double")
    assert {(p.x, p.y) for p in strokes.hulls(points, ["sheet_id"]).first().hull} == {(0, 0), (0, 4), (4, 0), (4, 4)}
    anchors = spark.createDataFrame([("s", "room", 400.0 + 30 * k, 420.0) for k in range(4)] + [("s", "room", 1900.0, 1900.0)], "sheet_id string, tag string, x double, y double")
    walls = spark.createDataFrame([("s", k, 200.0, x, y) for k, (x, y) in enumerate([(350.0, 350.0), (560.0, 350.0), (560.0, 480.0), (350.0, 480.0)])], "sheet_id string, chain int, length double, x double, y double")
    b = site.buildings(walls, anchors, F.lit(2000), F.lit(2000)).first()
    assert tuple(b.building_bbox) == (350, 350, 560, 480) and len(b.building_polygon) == 4


def sheet_spans(spark):
    rows = [("MAP LEGEND", 1600, 100, 1750, 120), ("EXISTING CONTOUR", 1650, 140, 1800, 155), ("ZIG", 1650, 180, 1700, 195), ("ZAG", 1650, 200, 1700, 215), ("GENERAL NOTES", 1600, 600, 1750, 620), ("SHEET TITLE", 1600, 1000, 1750, 1020), ("SCALE: 1\" = 20'", 1600, 1100, 1700, 1115), ("1010.25", 500, 500, 540, 510), ("CURB CUT AHEAD", 300, 300, 400, 310), ("1000.5", 520, 620, 560, 630), ("1003.5", 720, 720, 760, 730)]
    return spark.createDataFrame([("s", i, t, (float(a), float(b), float(c), float(d))) for i, (t, a, b, c, d) in enumerate(rows)], f"sheet_id string, seq int, text string, bbox_px {BOX}")


def test_layout_and_legend(spark):
    sheets = spark.createDataFrame([("s", "proposed", 2000, 1400), ("t", "existing", 1000, 800)], "sheet_id string, role string, width_px int, height_px int")
    plan = {r.sheet_id: r for r in layout.layouts(sheet_spans(spark), sheets).collect()}
    s = plan["s"]
    assert 1240 <= s.split <= 1640 and tuple(s.drawing_bbox) == (0, 0, s.split, 1400)
    assert tuple(s.title_bbox) == (s.split, 990, 2000, 1400) and tuple(s.notes_bbox) == (s.split, 590, 2000, 994)
    assert s.legend_bbox.y1 <= 986 and s.legend_bbox.x1 == 2000 and s.scale_bbox.y0 == 1080
    assert plan["t"].legend_bbox is None and plan["t"].split == 700
    regions = layout.regions(layout.layouts(sheet_spans(spark), sheets)).where("sheet_id = 's'").orderBy("seq")
    assert [r.name for r in regions.collect()] == ["drawing", "notes", "legend", "title_block", "scale"]
    rows = legend.legends(sheet_spans(spark), layout.layouts(sheet_spans(spark), sheets)).orderBy("seq").collect()
    assert [(r.name, r.symbol_hint, r.source) for r in rows] == [("EXISTING CONTOUR", "dashed contour line", "pdf_legend_panel"), ("ZIG ZAG", "see legend graphic", "pdf_legend_panel"), ("Curb Cut", "triangle / taper symbol", "pdf_keyword")]


def test_facade(spark, tmp_path):
    sheets = spark.createDataFrame([("s", "site", "proposed", 100, 2000, 1400), ("e", "site", "existing", 100, 2000, 1400)], "sheet_id string, site_id string, role string, dpi int, width_px int, height_px int")
    spans = sheet_spans(spark)
    spans = spans.unionByName(spans.withColumn("sheet_id", F.lit("e")))
    points = spark.createDataFrame([(s, 1, k, 400.0 + 40 * k, 505.0 + 30 * k) for s in "se" for k in range(10)], "sheet_id string, poly_seq int, pos int, x double, y double")
    kinds = spark.createDataFrame([("s", 1, "proposed"), ("e", 1, "topo")], "sheet_id string, poly_seq int, kind string")
    t = cutfill.understand(sheets, spans, points, kinds, str(tmp_path))
    assert t.elevations.where("sheet_id = 's'").count() == 3 and t.associations.count() >= 2
    roles = sheets.select("sheet_id", "role")
    px = cutfill.samples_px(t, points, roles, False, str(tmp_path))
    sides = {}
    for role in ("proposed", "existing"):
        own = sheets.where(F.col("role") == role)
        sides[role] = cutfill.to_feet(px.join(own, "sheet_id", "left_semi").select(*px.columns), own, t)
    small = cutfill.Params(fused_grid_n=12)
    v, score = cutfill.fused_volumes(sides["proposed"], sides["existing"], spark.createDataFrame([("site", 1.0, 1.0)], "site_id string, cut_cy double, fill_cy double"), small)
    r = v.first()
    assert r.ok and r.cell_count > 20 and score.first().truth_cut_cy == 1.0


def test_layers_and_status(spark):
    points = spark.createDataFrame([("s", k, p, float(p), 0.0) for k in (1, 2, 3) for p in range(2)] + [("s", 4, 0, 0.0, 0.0)], "sheet_id string, poly_seq int, pos int, x double, y double")
    kinds = spark.createDataFrame([("s", 1, "existing"), ("s", 2, "topo"), ("s", 3, "building"), ("s", 4, "topo")], "sheet_id string, poly_seq int, kind string")
    v = layers.layer_vertices(points, kinds, 2.0).orderBy("layer", "poly_seq", "pos").collect()
    assert [(r.layer, r.poly_seq, r.x) for r in v] == [("existing", 1, 0.0), ("existing", 1, 2.0), ("existing", 1, None), ("proposed", 2, 0.0), ("proposed", 2, 2.0), ("proposed", 2, None)]
    assert spark.range(1).select(layers.hex_color(F.lit("#FF8001"))).first()[0] == [1, 128, 255]
    s = spark.createDataFrame([("s", "proposed", "default", 0, 10, 1, 0, 5, 2, 1, True, True)], "sheet_id string, role string, scale_source string, n_legend int, n_elevations int, n_property int, n_building int, n_polylines int, n_associations int, n_existing_samples int, computed boolean, ok boolean")
    r = layers.stage_status(s).first()
    assert r.status["cut_fill"] == "done" and r.status["legend"] == "empty" and len(r.warnings) == 4


def test_topo_filter_and_zones(spark):
    ring = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 900.0), (0.0, 900.0)]
    where = spark.createDataFrame([("s", 1000, 900, ring, None, (100, 100, 300, 300))], "sheet_id string, width int, height int, property_polygon array<struct<x: double, y: double>>, building_polygon array<struct<x: double, y: double>>, building_bbox struct<x0: int, y0: int, x1: int, y1: int>")
    curve = [(1, k, 500.0 + 10 * k, 500 + 40.0 * (k % 2)) for k in range(10)]
    wall = [(2, k, 100.0 + 20 * k, 100.0) for k in range(10)]
    outside = [(3, k, 1500.0 + 10 * k, 500 + 40.0 * (k % 2)) for k in range(10)]
    points = spark.createDataFrame([("s", *p) for p in curve + wall + outside], "sheet_id string, poly_seq int, pos int, x double, y double")
    kinds = spark.createDataFrame([("s", k, "topo") for k in (1, 2, 3)], "sheet_id string, poly_seq int, kind string")
    names = spark.createDataFrame([("s", "CONCRETE SIDEWALK"), ("s", "CURB CUT")], "sheet_id string, name string")
    got = site.topo_filter(points, polylines.metrics(points), kinds, where, legend.rejected_styles(names))
    assert {r.poly_seq: r.keep for r in got.collect()} == {1: True, 2: False, 3: False}
    assert legend.rejected_styles(names).first().styles == ["building_solid", "hatch", "property_dashdot", "symbol"]
    z = [tuple(r.bbox) for r in site.zones(where).orderBy("seq").collect()]
    assert len(z) == 4 and z[0][:2] == (0, 0)


def test_tables_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "1010.25", 0.0, 0.0, "proposed"), ("a", 2, "ME", 10.0, 0.0, "proposed"), ("b", 1, "1010", 0.0, 0.0, "existing")], arrivals.SPANS)
    rows.write.parquet(f"{tmp_path}/in")
    q = arrivals.stream_elevations(arrivals.arriving_spans(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("sheet_id").collect()
    assert [(r.sheet_id, r.value_ft, r.kind) for r in got] == [("a", 1010.25, "existing_match"), ("b", 1010.0, "existing_match")]
    lines = spark.createDataFrame([("a", 1, [(0.0, 1.0), (2.0, 3.0)])], "sheet_id string, seq int, points array<struct<x: float, y: float>>")
    tables.write_by_sheet(lines, f"{tmp_path}/lines")
    back = tables.read_table(spark, f"{tmp_path}/lines", "polylines").where("sheet_id = 'a'")
    assert values(tables.polyline_points(back), "poly_seq", "pos", "x", "y") == [(1, 0, 0.0, 1.0), (1, 1, 2.0, 3.0)]


def test_merging_levels(spark):
    line = lambda k, y, n: [("s", k, p, 5.0 * p, y) for p in range(n)]
    points = spark.createDataFrame(line(1, 0.0, 40) + line(2, 4.0, 20) + line(3, 4.0, 20) + line(4, 300.0, 10), "sheet_id string, poly_seq int, pos int, x double, y double")
    levels = polylines.metrics(points).select("sheet_id", "poly_seq", "length_px").withColumn("z", F.when(F.col("poly_seq") != 3, 900.0))
    assert {r.poly_seq for r in polylines.merge_same_level(points, levels).collect()} == {1, 3, 4}
    # Just over half of the long one's samples lie along the short ones.
    assert {r.poly_seq for r in polylines.redundant(points).collect()} == {1, 2, 3}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_registered_volumes_on_the_operators_own_grids(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("site_volumes", "nearest_volumes"):
        rows = QUERIES[name](spark, sf).collect()
        assert {r.cell_count for r in rows if r.ok} == {DEFAULTS.grid_n**2}, name
    # An ellipse of the 140 x 140 nodes.
    assert DEFAULTS.fused_grid_n**2 > max(r.cell_count for r in QUERIES["fused_volumes"](spark, sf).collect()) > 0.3 * DEFAULTS.fused_grid_n**2


def test_zones_count_every_pixel(spark):
    rng = np.random.default_rng(4)
    ring = [(50.3, 20.0), (930.0, 80.5), (700.0, 500.0), (880.7, 870.0), (120.0, 790.2), (300.0, 400.0)]
    house = [(400.2, 300.0), (640.0, 310.5), (610.0, 600.0), (380.0, 560.9)]
    kind = "array<struct<x: double, y: double>>"
    rows = [("both", 1000, 900, ring, house, None), ("box", 1000, 900, ring, None, (200, 200, 500, 640)), ("house", 1000, 900, None, house, None), ("none", 1000, 900, None, None, None), ("far", 1000, 900, [(2000.0, 0.0), (2100.0, 0.0), (2100.0, 90.0)], None, None), ("off", 500, 400, None, None, (400, -50, 900, 120))]
    where = spark.createDataFrame(rows, f"sheet_id string, width int, height int, property_polygon {kind}, building_polygon {kind}, building_bbox struct<x0: int, y0: int, x1: int, y1: int>")

    def inside(x, y, ring):
        odd = np.zeros(x.shape, bool)
        for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1], strict=True):
            if py != qy:
                odd ^= ((py > y) != (qy > y)) & (x < (qx - px) * (y - py) / (qy - py) + px)
        return odd

    want = set()
    for name, w, h, ring_, house_, box in rows:
        y, x = np.mgrid[0:h, 0:w]
        free = inside(x, y, ring_) if ring_ else np.ones((h, w), bool)
        if house_:
            free &= ~inside(x, y, house_)
        elif box:
            free &= ~((x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3]))
        k = 0
        for ty in range(0, h, 400):
            for tx in range(0, w, 480):
                t = free[ty : ty + 400, tx : tx + 480]
                ys, xs = np.nonzero(t)
                if t.mean() >= 40 / 255 and len(xs) and np.ptp(xs) > 100 and np.ptp(ys) > 100:
                    want.add((name, k, tx + xs.min(), ty + ys.min(), tx + xs.max(), ty + ys.max()))
                    k += 1
    assert {(r.sheet_id, r.seq, *r.bbox) for r in site.zones(where).collect()} == want and len(want) > 12 and rng is not None


def test_nearest_on_sites_of_any_size(spark):
    rng = np.random.default_rng(5)
    cells, points = [], []
    for k, (size, n) in enumerate(((1.0, 3), (50.0, 40), (90_000.0, 60), (3.0, 1), (10.0, 200))):
        points += [(f"s{k}", float(x), float(y), i, float(i)) for i, (x, y) in enumerate(rng.uniform(0, size, (n, 2)) * (0.1 if k == 4 else 1))]
        cells += [(f"s{k}", float(x), float(y), i) for i, (x, y) in enumerate(rng.uniform(-size / 2, size * 1.5, (60, 2)))]
    points += [("s1", 7.0, 7.0, 900, 900.0), ("s1", 7.0, 7.0, 901, 901.0)]
    cells += [("s1", 7.0, 7.0, 99), ("none", 0.0, 0.0, 0)]
    got = spatial.nearest(spark.createDataFrame(cells, "k string, x double, y double, i int"), spark.createDataFrame(points, "k string, px double, py double, seq long, z double"), ["k"])
    want = {(k, i): min(((x - a) ** 2 + (y - b) ** 2, s, z) for q, a, b, s, z in points if q == k)[2] if k != "none" else None for k, x, y, i in cells}
    assert {(r.k, r.i): r.z for r in got.collect()} == want


def test_labels_over_spans(spark):
    words = [("s", 1, "LIMIT OF"), ("s", 2, "disturbance"), ("s", 3, "curb"), ("s", 4, "x"), ("s", 5, "cut"), ("t", 1, "SILT"), ("t", 2, "FENCE and SILT FENCE")]
    spans = spark.createDataFrame([(a, i, t, (10.0 * i, 5.0, 10.0 * i + 8, 9.0)) for a, i, t in words], f"sheet_id string, seq int, text string, bbox_px {BOX}")
    plan = spark.createDataFrame([("s", None, (0, 0, 900, 900)), ("t", None, (0, 0, 900, 900))], f"sheet_id string, legend_bbox {BOX}, drawing_bbox struct<x0: int, y0: int, x1: int, y1: int>")
    assert {(r.sheet_id, r.name, r.bbox and r.bbox.x0) for r in legend.legends(spans, plan).collect()} == {("s", "Limit Of Disturbance", None), ("t", "Silt Fence", 20.0)}


def test_recognised_texts_join_poor_sheets(spark):
    sheets = spark.createDataFrame([(s, "proposed", (0.0, 0.0, 500.0, 500.0), []) for s in "ab"], f"sheet_id string, role string, drawing_bbox {BOX}, chrome_bboxes array<{BOX}>")
    spans = spark.createDataFrame([(s, i, f"{900 + i}.5", 20.0 * i, 10.0) for s, n in (("a", 7), ("b", 8)) for i in range(n)], "sheet_id string, seq long, text string, x double, y double")
    read = spark.createDataFrame([(s, 100 + i, f"90{i}.25", 30.0 * i, y, 0.7) for s in "ab" for i, y in ((1, 300.0), (2, 300.0), (3, 600.0))], "sheet_id string, seq long, text string, x double, y double, score double")
    got = elevations.elevations(spans, sheets, DEFAULTS, read)
    assert {(r.sheet_id, r.seq) for r in got.where("source = 'ocr'").collect()} == {("a", 101), ("a", 102)} and got.count() == 17


def test_detection(spark, tmp_path):
    """Sheets from texts and strokes to volumes: a property of dashes around rooms, walls, contours and callouts."""
    sheets = spark.createDataFrame([("s", "site", "proposed", 100, 2000, 1400), ("e", "other", "existing", 100, 2000, 1400)], "sheet_id string, site_id string, role string, dpi int, width_px int, height_px int")
    rooms = spark.createDataFrame([("s", 500 + i, str(100 + i), (x, y, x + 20.0, y + 10.0)) for i, (x, y) in enumerate(((600.0, 500.0), (700.0, 500.0), (600.0, 600.0), (700.0, 600.0)))], f"sheet_id string, seq int, text string, bbox_px {BOX}")
    spans = sheet_spans(spark)
    spans = spans.unionByName(spans.withColumn("sheet_id", F.lit("e"))).unionByName(rooms)
    lines = []
    for x1, y1, dx, dy, n in ((200, 200, 1, 0, 36), (200, 1100, 1, 0, 36), (200, 200, 0, 1, 36), (1100, 200, 0, 1, 36)):
        lines += [(x1 + dx * 25 * k, y1 + dy * 25 * k, dx, dy, 18 if k % 3 == 0 else 5, 1.0) for k in range(n)]
    for x1, y1, dx, dy in ((550, 450, 1, 0), (550, 700, 1, 0), (550, 450, 0, 1), (800, 450, 0, 1)):
        lines += [(x1 + dx * 50 * k, y1 + dy * 50 * k, dx, dy, 45, 2.0) for k in range(5)]
    strokes_ = spark.createDataFrame([(s, i, float(x), float(y), float(x + dx * n), float(y + dy * n), w, 0.0) for s in "se" for i, (x, y, dx, dy, n, w) in enumerate(lines)], "sheet_id string, seq long, x1 double, y1 double, x2 double, y2 double, w double, color0 double")
    points = spark.createDataFrame([(s, 1, k, 400.0 + 40 * k, 505.0 + 30 * k) for s in "se" for k in range(10)], "sheet_id string, poly_seq int, pos int, x double, y double")
    kinds = spark.createDataFrame([("s", 1, "proposed"), ("e", 1, "topo")], "sheet_id string, poly_seq int, kind string")
    d = cutfill.detect(sheets, spans, strokes.measured(strokes_), points, kinds, str(tmp_path), cutfill.Params(grid_n=12))
    found = {r.sheet_id: r for r in d.site.collect()}
    assert tuple(found["s"].property_bbox) == tuple(found["e"].property_bbox) and found["s"].property_bbox.x0 == 200 and len(found["s"].property_polygon) >= 4
    assert tuple(found["s"].building_bbox) == (550, 450, 800, 700) and found["s"].building_polygon is not None and found["e"].building_bbox is None and found["e"].n_building == 0
    assert d.zones.where("sheet_id = 's'").count() >= 2
    assert {r.name for r in d.regions.where("sheet_id = 's'").collect()} >= {"drawing", "property", "building", "topo_zone_1"}
    v = d.volumes.collect()
    assert [r.site_id for r in v] == ["site"] and v[0].ok and v[0].cell_count == 144
    status = {r.sheet_id: r.status for r in d.status.collect()}
    assert status["s"]["cut_fill"] == "done" and status["e"]["cut_fill"] == "deferred" and status["s"]["property"] == status["s"]["building"] == "done" and status["e"]["building"] == "empty"


def test_styles_from_legend_icons(spark):
    """Icons left of labels give swatches, swatches widen templates, and strokes take their kinds from them."""
    named = spark.createDataFrame([("s", 0, "EXISTING CONTOUR", (120.0, 20.0, 220.0, 32.0)), ("s", 1, "TINY", (3.0, 2.0, 9.0, 4.0))], f"sheet_id string, seq int, name string, bbox {BOX}")
    plan = spark.createDataFrame([("s", None)], "sheet_id string, legend_bbox struct<x0: int, y0: int, x1: int, y1: int>")
    icons = legend.icon_boxes(named, plan, spark.createDataFrame([("s", 60)], "sheet_id string, height_px int"))
    assert {r.name: r.icon and tuple(r.icon) for r in icons.collect()} == {"EXISTING CONTOUR": (22, 13, 116, 38), "TINY": (0, 0, 8, 10)}
    image = np.full((60, 240), 255, np.uint8)
    for x in range(26, 110, 12):
        image[24:28, x : x + 7] = 60
    rows = spark.createDataFrame([("s", y, bytearray(r.tobytes())) for y, r in enumerate(image)], "sheet_id string, y int, gray binary")
    p = raster.swatch_profiles(legend.swatch_rows(icons.where("seq = 0"), rows).drop("sheet_id"))
    r = p.first()
    assert r.pattern == "dashed" and 0.5 < r.ink_ratio < 0.7
    t = styles.refined(styles.templates(spark), p.withColumn("name", F.lit("existing_contour")))
    points = spark.createDataFrame([("s", k, i, 10.0 * i, 5.0 * (i % 2)) for k in (1, 2) for i in range(40)], "sheet_id string, poly_seq int, pos int, x double, y double")
    samples = spark.createDataFrame([("s", k, i, (60.0 if i % 6 < 3 else 250.0) if k == 1 else 60.0) for k in (1, 2) for i in range(48)], "sheet_id string, poly_seq int, pos int, gray double")
    kinds = spark.createDataFrame([("s", k, "topo") for k in (1, 2, 3)], "sheet_id string, poly_seq int, kind string")
    got = cutfill.styled_kinds(points, samples, kinds, spark.createDataFrame([("s", "proposed")], "sheet_id string, role string"), t)
    assert {r.poly_seq: r.kind for r in got.collect()} == {1: "existing", 2: "proposed", 3: "topo"}


def test_words_around_callouts(spark, monkeypatch):
    """Words near callouts are those of their contexts, at the rim, over several texts, on sheets of many texts; no context is put together where a word is near."""
    rng = np.random.default_rng(4)
    words = ["TC", "me", "OAK", "TOP", "TOP OF", "OF", "of  curb", " Curb", "", None, "ELM", "900", "950.5", "EL 900", "1,010.25"]
    rows = [(f"s{k % 6}", k, words[int(w)], round(float(x) / 10, 1), round(float(y) / 10, 1)) for k, (w, x, y) in enumerate(zip(rng.integers(2, len(words), 900), rng.integers(-9000, 9000, 900), rng.integers(-4000, 4000, 900), strict=True))]
    rows += [(f"s{k % 6}", 2000 + k, words[k % 2], 100.0 * k - 800, 10.0 * k) for k in range(12)] + [("t", k, "TOP" if k % 2 else "900", 70.0 * k, 0.1 * k) for k in range(4)] + [("t", 9, "ME", -70.0, 0.0), ("t", 10, "900.5", 0.1, 70.1), ("t", 11, "900", None, 1.0), (None, 12, "900", 1.0, 1.0)]
    rows += rows[:20]
    spans = spark.createDataFrame(rows, "sheet_id string, seq int, text string, x double, y double").withColumn("role", F.when(F.col("sheet_id") == "s1", "existing").otherwise("proposed"))
    wanted = F.regexp_replace(T.stripped(F.col("text")), ",", "").rlike(T.DECIMAL_ELEVATION) | F.regexp_replace(T.stripped(F.col("text")), ",", "").rlike(T.WHOLE_ELEVATION)
    want = elevations.with_context(spans, wanted, 70.0).select("*", F.col("context").rlike(T.ELEVATION_CONTEXT).alias("s"), F.col("context").rlike(T.MATCH_EXISTING).alias("m")).drop("context")
    got = elevations.with_words(spans, wanted, 70.0).select(*spans.columns, F.col("__speaks").alias("s"), F.col("__match").alias("m"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    seen = []
    monkeypatch.setattr(elevations, "contexts", lambda rows, *_: seen.append(rows.count()) or rows.withColumn("context", F.lit("")))
    dense = spark.range(4000).select(F.lit("d").alias("sheet_id"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "TC").otherwise("900").alias("text"), (F.col("id") % 60).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit("existing").alias("role"))
    assert elevations.read_elevations(dense, F.col("role")).where("confidence = 0.7").count() == 2000 and seen == [0]


def test_triangulation_grows_with_its_points():
    """Final triangles are set aside: the circles looked at for each point stay few, and the triangles are the same."""
    rng = np.random.default_rng(6)
    x, y = rng.random(4000) * 5000, rng.random(4000) * 300
    seen = []

    class Counted(np.ndarray):
        def __invert__(self):
            seen.append(len(self))
            return np.asarray(self).__invert__()

    plain = surfaces.circles
    try:
        surfaces.circles = lambda *a: plain(*a).view(Counted)
        got = sorted(surfaces.delaunay(x, y))
    finally:
        surfaces.circles = plain
    assert len(set(got)) == len(got) > 7900 and np.median(seen) < 1000
    t = np.array(got)[rng.integers(0, len(got), 200)]
    c = plain(x, y, t)
    held = (x[None] - c[:, :1]) ** 2 + (y[None] - c[:, 1:2]) ** 2 < c[:, 2:] * (1 - 1e-9)
    held[np.arange(len(t))[:, None], t] = False
    assert not held.any()


def test_scales_of_single_spans_meet_no_neighbours(spark, monkeypatch):
    met = []
    monkeypatch.setattr(scales, "range_join", lambda left, *rest: met.append(sorted(r.sheet_id for r in left.select("sheet_id").collect())) or spatial.range_join(left, *rest))
    spans = spark.createDataFrame([("a", 1, "SCALE:", 0.0, 0.0), ("a", 2, 'SCALE: 1" = 20 ft', 10.0, 0.0), ("b", 1, 'SCALE: 1" =', 0.0, 0.0), ("b", 2, "30'", 50.0, 10.0)], "sheet_id string, seq int, text string, x double, y double")
    got = {r.sheet_id: (r.ft_per_inch, r.source) for r in scales.detect_scales(spans, spans.select("sheet_id")).collect()}
    assert got == {"a": (20.0, "pdf_span"), "b": (30.0, "pdf_nearby")} and met == [["b"]]


def test_contexts_meet_in_tasks(spark, monkeypatch):
    """Crowded cells are dealt in parts and pieces; equal callouts, null texts and places, and callouts near nothing; no pairs are rows."""
    monkeypatch.setattr(elevations, "CALLOUTS", 3)
    monkeypatch.setattr(elevations, "PAIRS", 64)
    rng = np.random.default_rng(5)
    spans = [("ab"[k % 2], k, None if k % 7 == 3 else f"t{k}", float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-40, 40, (60, 2)))]
    spans += [("a", 90, "nowhere", None, 1.0), ("a", 91, "far", float("inf"), 1.0), ("a", 92, "not", float("nan"), 1.0), (None, 93, "none", 1.0, 1.0), ("c", 94, None, 5.0, 5.0)]
    calls = [s for s in spans if s[1] % 3 == 0] + [spans[6]] * 2 + [s for s in spans if s[1] > 90] + [("a", 99, "apart", 900.0, 900.0)]
    shape = "sheet_id string, seq int, text string, x double, y double"
    got = elevations.contexts(spark.createDataFrame(calls, shape), spark.createDataFrame(spans, shape), 10.0)
    want = {}
    for sheet, seq, _, x, y in set(calls):
        if sheet is None or x is None or not np.isfinite(x):
            continue
        near = sorted(s[1:3] for s in spans if s[0] == sheet and s[3] is not None and abs(s[3] - x) <= 10 and abs(s[4] - y) <= 10)
        if near:
            want[seq] = " ".join(t for _, t in near for _ in range(3 if seq == 6 else 1) if t is not None)
    rows = got.collect()
    assert got.columns == ["sheet_id", "seq", "text", "x", "y", "context"]
    assert len(rows) == len(want) and {r.seq: r.context for r in rows} == want
    assert want[94] == "" and 99 not in want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
