"""Claims of seeds against choosing one after another, and contours from callouts on a small page."""

from __future__ import annotations

import numpy as np
import pytest

from terracut.operators import seeded


def one_after_another(seeds, pixels, reach):
    """seeds: rank -> (x, y); pixels: (x, y) -> lines."""
    taken, out = set(), {}
    for rank, (sx, sy) in sorted(seeds.items()):
        near = sorted(((x - sx) ** 2 + (y - sy) ** 2, y, x) for (x, y), paths in pixels.items() if (x - sx) ** 2 + (y - sy) ** 2 < reach**2 and not paths & taken)
        if near:
            _, y, x = near[0]
            out[rank] = (min(pixels[x, y]), x, y)
            taken.add(min(pixels[x, y]))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_claims_are_those_of_one_seed_after_another(spark, seed):
    """Crossing lines, more seeds than lines, seeds on one pixel, and pages that do not mix."""
    rng = np.random.default_rng(seed)
    points, seeds, want = [], [], {}
    for sheet in ("a", "b", "c"):
        pixels = {}
        for path in range(9):
            x, y = rng.integers(0, 24, 2)
            step = [(1, 0), (0, 1), (1, 1)][path % 3]
            for pos in range(int(rng.integers(2, 15))):
                at = int(x + pos * step[0]), int(y + pos * step[1])
                pixels.setdefault(at, set()).add(path)
                points.append((sheet, path, pos, *at))
        places = list(pixels)
        chosen = {rank + 1: places[rng.integers(len(places))] for rank in range(25)}
        chosen[2] = chosen[1]
        seeds += [(sheet, rank, *at, 6.5) for rank, at in chosen.items()]
        want |= {(sheet, rank): v for rank, v in one_after_another(chosen, pixels, 6.5).items()}
    s = spark.createDataFrame(seeds, "sheet_id string, rank int, sx int, sy int, reach double")
    p = spark.createDataFrame(points, "sheet_id string, path long, pos long, x int, y int")
    got = {(r.sheet_id, r.rank): (r.path, r.x, r.y) for r in seeded.claims(seeded.seed_options(s, p, 7.0)).collect()}
    assert got == want
    assert len(want) < len(seeds) and any((sheet, 2) in want for sheet in "abc")
    assert seeded.claims(seeded.seed_options(s.where("false"), p)).isEmpty()


def test_first_come(spark):
    lines = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 0)], "sheet_id string, poly_seq long")
    covers = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 3, 2)], "sheet_id string, poly_seq long, other_seq long")
    assert sorted((r.sheet_id, r.poly_seq) for r in seeded.first_come(lines, covers).collect()) == [("a", 0), ("a", 2), ("a", 4), ("b", 0)]


def test_contours_of_callouts_and_fallback(spark):
    """Three waves on a page twice as large as is worked on: two are claimed, one by a label and one by a spot whose nearest line is taken; the third is found without a seed."""
    yy, xx = np.mgrid[:240, :400]
    page = np.full((240, 400), 245, np.uint8)
    middle = [40, 110, 180]
    for k, m in enumerate(middle):
        page[(np.abs(yy - m - 12 * np.sin(xx / 40)) < 2) & ((xx % 40 >= 5) | (k != 1)) & (xx > 10) & (xx < 390)] = 60
    rows = spark.createDataFrame([("p", y, bytearray(r.tobytes())) for y, r in enumerate(page)], "sheet_id string, y int, gray binary")
    calls = [("p", 0, "existing_match", 101.0, 200.0, 26.0), ("p", 1, "spot", 102.0, 120.0, 66.0), ("p", 2, "spot", 103.0, 300.0, 120.0), ("p", 3, "spot", 99.0, 900.0, 10.0)]
    e = spark.createDataFrame(calls, "sheet_id string, seq int, kind string, value_ft double, x double, y double")
    roles = spark.createDataFrame([("p", "proposed")], "sheet_id string, role string")
    points, facts = seeded.seeded_contours(rows, e, roles, longest=200, least_length=100, size=64)
    lines, facts = {}, {r.poly_seq: r for r in facts.collect()}
    for r in points.orderBy("poly_seq", "pos").collect():
        lines.setdefault(r.poly_seq, []).append((r.x, r.y))
    assert set(lines) == set(facts) == set(range(1, len(lines) + 1))
    wave = {k: int(np.argmin([np.mean([abs(y - m - 12 * np.sin(x / 40)) for x, y in p]) for m in middle])) for k, p in lines.items()}
    by = {(wave[k], f.source): f for k, f in facts.items()}
    assert by[0, "seeded"].z == 101.0 and by[0, "seeded"].label_kind == "existing_match"
    assert by[1, "seeded"].z in (102.0, 103.0)
    assert by[2, "skeleton_fallback"].z is None
    assert max(x for x, _ in lines[next(k for k in lines if wave[k] == 0)]) > 350


OPTION = "sheet_id string, rank int, paths array<long>, at struct<d2:int,y:int,x:int>"


def test_lines_of_later_seeds_cover_nothing(spark):
    """Seed 3 is sure of line 9 while seed 2 waits for seed 1; then seed 2 still gets line 4 at the pixel that lies on both."""
    options = spark.createDataFrame([("a", 1, [2], (0, 0, 0)), ("a", 2, [2], (1, 0, 0)), ("a", 2, [4, 9], (2, 1, 0)), ("a", 3, [9], (0, 5, 0))], OPTION)
    got = {r.rank: r.path for r in seeded.claims(options).collect()}
    assert got == {1: 2, 2: 4, 3: 9}


@pytest.mark.parametrize("cell", [512, 40])
def test_seeds_that_wait_for_each_other_take_few_rounds(spark, monkeypatch, cell):
    """Each seed's nearest line is what the seed before it might take: settled within a cell at once, whatever their number."""
    n, rounds = 60, []
    monkeypatch.setattr(seeded, "kept", lambda df, name, kept=seeded.kept: (rounds.append(name), kept(df, name))[1])
    rows = [("a", k, [k - 1], (1, k, 0)) for k in range(1, n + 1)] + [("a", k, [k], (4, k, 3)) for k in range(1, n + 1)]
    got = {r.rank: r.path for r in seeded.claims(spark.createDataFrame(rows, OPTION), cell).collect()}
    assert got == {k: k - 1 for k in range(1, n + 1)}
    assert rounds.count("claims") <= 4


def test_options_do_not_go_through_the_driver(spark):
    points = spark.range(1).selectExpr("CAST(id AS STRING) AS sheet_id", "1L AS path", "id AS pos", "CAST(id AS INT) + 3 AS x", "CAST(id AS INT) + 3 AS y")
    seeds = spark.range(1).selectExpr("CAST(id AS STRING) AS sheet_id", "CAST(id AS INT) + 1 AS rank", "CAST(id AS INT) + 3 AS sx", "CAST(id AS INT) + 4 AS sy", "6.5D AS reach")
    found = seeded.seed_options(seeds, points, 7.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert [(r.paths, tuple(r["at"])) for r in found.collect()] == [([1], (1, 3, 3))]
