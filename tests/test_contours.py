"""Contours from pixels against plain numpy, for any size of tiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracut.operators import approximate, curved, runs, tiles, trace


def rows_of(spark, images):
    return spark.createDataFrame([(k, y, bytearray(row.tobytes())) for k, im in images.items() for y, row in enumerate(im)], "sheet_id string, y int, gray binary")


def page_with_lines(seed, h=70, w=90):
    rng = np.random.default_rng(seed)
    page = rng.integers(215, 240, (h, w)).astype(np.uint8)
    yy, xx = np.mgrid[:h, :w]
    for k in range(4):
        page[np.abs(yy - (15 * k + 8) - 6 * np.sin(xx / (9 + k))) < 0.8 + k / 2] = 90 + 10 * k
    page[30:50, 60:80] = 40
    return page


@pytest.fixture(scope="module")
def pages():
    return {"a": page_with_lines(0), "b": page_with_lines(1, 41, 33), "c": np.full((5, 4), 255, np.uint8)}


def to_mask(found, shape):
    mask = np.zeros(shape, bool)
    for r in found:
        mask[r.y, r.x0 : r.x1 + 1] = True
    return mask


def masks(found, pages):
    got = found.collect()
    return {k: to_mask([r for r in got if r.sheet_id == k], im.shape) for k, im in pages.items()}


def test_runs_closing_and_complement(spark, pages):
    rows = rows_of(spark, pages)
    sizes = runs.page_sizes(rows)
    ink = runs.ink_runs(rows, 150)
    for k, m in masks(ink, pages).items():
        assert (m == (pages[k] < 150)).all()

    def grown(mask, size):
        out = np.zeros_like(mask)
        half = size // 2
        for dy, w in enumerate(runs.ROUND[size]):
            for dx in range(-w, w + 1):
                p = np.pad(mask, half)
                out |= p[dy : dy + mask.shape[0], half + dx : half + dx + mask.shape[1]]
        return out

    for size, times in ((3, 2), (5, 4)):
        for k, m in masks(runs.closed(ink, sizes, size, times), pages).items():
            want = pages[k] < 150
            for _ in range(times):
                want = grown(want, size)
            want = ~want
            for _ in range(times):
                want = grown(want, size)
            assert (m == ~want).all(), (k, size)
    empty = runs.closed(ink.limit(0), sizes, 3, 1)
    assert empty.count() == 0


def test_parts(spark):
    """A spiral, a comb and diagonal steps: long chains of runs are one part."""
    spiral = np.full((41, 41), 255, np.uint8)
    x = y = 20
    for k in range(1, 20):
        for dx, dy, n in (((1, 0, 2 * k - 1), (0, 1, 2 * k - 1)) if k % 2 else ((-1, 0, 2 * k - 1), (0, -1, 2 * k - 1))):
            for _ in range(n):
                if 0 <= x < 41 and 0 <= y < 41:
                    spiral[y, x] = 0
                x, y = x + dx, y + dy
    steps = np.full((200, 200), 255, np.uint8)
    steps[np.arange(200), np.arange(200)] = 0
    steps[5, 100:190] = 0
    steps[0, 60:70] = steps[1, 70:75] = 0
    found = runs.part_measures(runs.labelled(runs.ink_runs(rows_of(spark, {"s": spiral, "t": steps}), 128))).collect()
    assert sorted((r.sheet_id, r.area, r.x0, r.y0, r.x1, r.y1) for r in found if r.sheet_id == "t") == [("t", 15, 60, 0, 74, 1), ("t", 90, 100, 5, 189, 5), ("t", 200, 0, 0, 199, 199)]
    seen, parts = np.zeros_like(spiral, bool), 0
    for a, b in zip(*np.nonzero(spiral == 0), strict=True):
        if not seen[a, b]:
            parts, todo = parts + 1, [(a, b)]
            seen[a, b] = True
            while todo:
                p, q = todo.pop()
                for r in range(max(0, p - 1), min(41, p + 2)):
                    for s in range(max(0, q - 1), min(41, q + 2)):
                        if spiral[r, s] == 0 and not seen[r, s]:
                            seen[r, s] = True
                            todo.append((r, s))
    assert sum(r.sheet_id == "s" for r in found) == parts and sum(r.area for r in found if r.sheet_id == "s") == (spiral == 0).sum()


def test_ridges_do_not_depend_on_tiles(spark, pages):
    rows = rows_of(spark, pages)
    sizes = runs.page_sizes(rows)
    whole = masks(tiles.ridge_mask(rows, sizes, 256), pages)
    for size in (16, 37):
        for k, m in masks(tiles.ridge_mask(rows, sizes, size), pages).items():
            assert (m == whole[k]).all(), (k, size)
    levels = tiles.ridge_levels(np.pad(pages["a"].astype(float), tiles.HALO, "symmetric"))[tiles.HALO : -tiles.HALO, tiles.HALO : -tiles.HALO]
    strong = levels >= max(np.quantile(levels, 0.9), 1)
    assert (whole["a"] >= strong).all() and whole["a"].mean() < 0.5 and not whole["c"].any()
    assert whole["a"][pages["a"] < 110].mean() > 0.9  # the lines are found


def test_thinning_equals_plain_passes(spark, pages):
    ink = runs.ink_runs(rows_of(spark, pages), 150)
    for size, passes in ((256, 8), (16, 3), (16, 1)):
        thin = masks(tiles.tile_runs(tiles.thinned(tiles.bit_tiles(ink, size), size, passes), size), pages)
        for k, m in thin.items():
            want = pages[k] < 150
            while True:
                now = tiles.thin(want, 1)
                if (now == want).all():
                    break
                want = now
            assert (m == want).all(), (k, size)
    assert thin["a"].sum() < (pages["a"] < 150).sum() / 2
    assert tiles.thinned(tiles.bit_tiles(ink.limit(0), 16), 16, 1).count() == 0
    with pytest.raises(ValueError):
        tiles.thinned(tiles.bit_tiles(ink, 8), 8, 8)


def plain_split(points, tolerance):
    """Positions kept, by recursion."""
    (ax, ay), (bx, by) = points[0], points[-1]
    size = (bx - ax) ** 2 + (by - ay) ** 2
    far = [((bx - ax) * (y - ay) - (by - ay) * (x - ax)) ** 2 / size if size else (x - ax) ** 2 + (y - ay) ** 2 for x, y in points[1:-1]]
    if not far or max(far) <= tolerance**2:
        return [0, len(points) - 1]
    at = far.index(max(far)) + 1
    return plain_split(points[: at + 1], tolerance) + [at + k for k in plain_split(points[at:], tolerance)[1:]]


def test_simplified_equals_recursion(spark):
    rng = np.random.default_rng(3)
    lines = {k: np.cumsum(rng.integers(-3, 4, (n, 2)), 0) for k, n in enumerate((1, 2, 3, 40, 300))}
    lines[9] = np.array([[0, 0], [3, 4], [6, 0], [0, 0]])  # ends fall together
    lines[10] = np.array([[0, 0], [2, 3], [4, 3], [6, 0]])  # two points equally far: the first
    rows = [(k, i, float(x), float(y)) for k, p in lines.items() for i, (x, y) in enumerate(p)]
    points = spark.createDataFrame(rows, "line int, pos int, x double, y double").repartition(3)
    got = {}
    for r in approximate.simplified(points, ["line"], 2.0).collect():
        got.setdefault(r.line, []).append(r.pos)
    for k, p in lines.items():
        assert sorted(got[k]) == (sorted(set(plain_split(p.tolist(), 2.0))) if len(p) > 1 else [0]), k
    assert approximate.simplified(points.limit(0), ["line"], 2.0).count() == 0
    square = points.where(F.lit(False)).unionAll(spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, 4.0, 3.0), (1, 3, 0.0, 3.0)], points.schema))
    assert [tuple(r) for r in approximate.ring_measures(square, ["line"]).collect()] == [(1, 4, 14.0, 12.0)]


def drawn(rows):
    return np.array([[255 if c == "." else 0 for c in row] for row in rows], np.uint8)


def paths_of(found):
    out = {}
    for r in found.collect():
        out.setdefault((r.sheet_id, r.path), {})[r.pos] = (r.x, r.y)
    return {k: [p[i] for i in range(len(p))] for k, p in out.items()}


def test_traced_lines(spark):
    """A line, a crossing, a T, a ring, a ring with a tail, a dot, and a diagonal with a corner."""
    cross = drawn(["....#....", "....#....", "#########", "....#....", "....#...."])
    tee = drawn(["#######", "...#...", "...#...", "...#..."])
    ring = drawn(["..##..", ".#..#.", "#....#", ".#..#.", "..##..", "......"])
    step = drawn(["#....", ".##..", "...#.", "...#.", "#...."])
    long_line = np.full((3, 1000), 255, np.uint8)
    long_line[1] = 0
    got = paths_of(trace.traced(trace.pixels_of(runs.ink_runs(rows_of(spark, {"x": cross, "t": tee, "o": ring, "s": step, "l": long_line}), 128))))
    lines = {}
    for (sheet, _), p in got.items():
        lines.setdefault(sheet, []).append(p)
    assert sorted(map(len, lines["x"])) == [5, 9] and sorted(lines["x"], key=len)[1] == [(i, 2) for i in range(9)]
    assert sorted(lines["t"], key=len) == [[(3, 0), (3, 1), (3, 2), (3, 3)], [(i, 0) for i in range(7)]]
    assert len(lines["o"]) == 1 and lines["o"][0][0] == lines["o"][0][-1] == (2, 0) and len(set(lines["o"][0])) == 10
    assert lines["s"] == [[(0, 0), (1, 1), (2, 1), (3, 2), (3, 3)]]
    assert lines["l"] == [[(i, 1) for i in range(1000)]]
    assert trace.traced(spark.createDataFrame([], "sheet_id string, x int, y int")).count() == 0


def test_every_edge_is_in_one_line(spark, pages):
    pixels = trace.pixels_of(runs.ink_runs(rows_of(spark, pages), 150))
    points = trace.traced(pixels)
    lengths = {(r.sheet_id, r.path): r.length for r in trace.line_lengths(points).collect()}
    edges = []
    for (sheet, path), p in paths_of(points).items():
        assert abs(lengths[sheet, path] - sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(p, p[1:], strict=False))) < 1e-9
        edges += [(sheet, *sorted((a, b))) for a, b in zip(p, p[1:], strict=False)]
    ink = {(r.sheet_id, r.x, r.y) for r in pixels.collect()}
    want = {(s, *sorted(((x, y), (x + dx, y + dy)))) for s, x, y in ink for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)) if (s, x + dx, y + dy) in ink and not (dx and dy and ((s, x + dx, y) in ink or (s, x, y + dy) in ink))}
    assert len(edges) == len(set(edges)) and set(edges) == want


def test_curved_contours_follow_the_lines(spark):
    """Four wavy lines, two of them dashed, on a page twice as large as is worked on; a speck is left out."""
    yy, xx = np.mgrid[:240, :400]
    page = np.full((240, 400), 245, np.uint8)
    middle = [40 + 55 * k for k in range(4)]
    for k, m in enumerate(middle):
        page[(np.abs(yy - m - 12 * np.sin(xx / 40)) < 2) & ((xx % 40 >= 7) | (k % 2 == 0)) & (xx > 10) & (xx < 390)] = 60
    page[3:5, 200:202] = 50
    got = curved.curved_contours(rows_of(spark, {"a": page}), longest=200, least_length=100, size=64).collect()
    lines = {}
    for r in got:
        lines.setdefault(r.poly_seq, []).append(r)
    off = lambda p: [abs(p.y - m - 12 * np.sin(p.x / 40)) for m in middle]
    assert all(min(off(p)) < 7 for points in lines.values() for p in points)
    assert {int(np.argmin(off(points[0]))) for points in lines.values()} == {0, 1, 2, 3}
    assert max(max(p.x for p in points) - min(p.x for p in points) for points in lines.values()) > 300


def test_joins_of_pixels_do_not_go_through_the_driver(spark):
    """Packed pixels are small as files and large in memory, so their joins exchange them between tasks, whatever the files' size."""
    pixels = spark.range(9).selectExpr("'a' AS sheet_id", "CAST(id AS INT) AS x", "1 AS y")
    ink = spark.range(9).selectExpr("'a' AS sheet_id", "CAST(id AS INT) AS y", "0 AS x0", "3 AS x1")
    lines = pixels.selectExpr("sheet_id", "1L AS path", "CAST(x AS LONG) AS pos", "x", "y")
    for df in (trace.arcs_of(pixels), runs.neighbour_runs(ink), trace.line_lengths(lines)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("strip, fan", [(2, 2), (4, 3), (1024, 64)])
def test_parts_across_strips_take_few_rounds(spark, monkeypatch, strip, fan):
    """Random ink, runs that overlap or come twice, and one line down the whole page, against flooding; tasks label strips, so rounds are few."""
    monkeypatch.setattr(runs, "STRIP", strip)
    monkeypatch.setattr(runs, "FAN", fan)
    names = []
    monkeypatch.setattr(runs, "kept", lambda df, name, kept=runs.kept: (names.append(name), kept(df, name))[1])
    rng = np.random.default_rng(strip)
    rows = [("ab"[k % 2], int(y), int(x), int(x + n)) for k, (y, x, n) in enumerate(zip(rng.integers(0, 60, 160), rng.integers(0, 40, 160), rng.integers(0, 4, 160), strict=True))]
    rows = list({r[:3]: r for r in rows}.values())
    rows += [("a", y, 60 + y % 2, 60 + y % 2) for y in range(60)] + [("b", 3, 50, 59), ("b", 3, 52, 53), ("b", 4, 58, 58), ("b", 4, 58, 58)]
    label = {r[:3]: (r[1] << 32) + r[2] for r in rows}
    moved = True
    while moved:
        moved = False
        for a in rows:
            for b in rows:
                if a[0] == b[0] and b[1] == a[1] + 1 and a[2] <= b[3] + 1 and b[2] <= a[3] + 1 and label[a[:3]] != label[b[:3]]:
                    label[a[:3]] = label[b[:3]] = min(label[a[:3]], label[b[:3]])
                    moved = True
    got = runs.labelled(spark.createDataFrame(rows, "sheet_id string, y int, x0 int, x1 int")).collect()
    assert sorted(tuple(r) for r in got) == sorted((*r, label[r[:3]]) for r in rows)
    assert len({r.label for r in got if r.sheet_id == "a" and r.x0 >= 60}) == 1
    assert len(names) <= {2: 12, 4: 8, 1024: 2}[strip]


@pytest.mark.parametrize("pixels", [40, 1 << 20])
def test_pages_are_brought_down_exactly(spark, monkeypatch, pixels):
    """Area means of ragged pages in strips of any size, and of a page of over two million rows, whose overlaps fill more than 32 bits."""
    monkeypatch.setattr(runs, "STRIP_PIXELS", pixels)
    rng = np.random.default_rng(5)
    images = {k: [rng.integers(0, 256, w - (k == "ragged") * int(rng.integers(0, 9))).astype(np.uint8) for _ in range(h)] for k, (w, h) in {"wide": (37, 11), "high": (9, 41), "ragged": (30, 23), "small": (5, 4)}.items()}
    gray = spark.createDataFrame([(k, y, bytearray(r.tobytes())) for k, im in images.items() for y, r in enumerate(im)], "sheet_id string, y int, gray binary")
    got = {(r.sheet_id, r.y): list(r.gray) for r in runs.downscaled(gray, runs.page_sizes(gray), 13).collect()}
    for k, im in images.items():
        width, side = max(map(len, im)), max(len(im), *map(len, im))
        w, h = (round(n * 13 / side) if side > 13 else n for n in (width, len(im)))
        for ty in range(h):
            want = []
            for tx in range(w):
                if side <= 13:
                    want.append(int(im[ty][tx]))
                    continue
                o = lambda a, t: max(0, min((a + 1) * 13, (t + 1) * side) - max(a * 13, t * side))
                cells = [(o(x, tx) * o(y, ty), int(v)) for y, r in enumerate(im) for x, v in enumerate(r) if o(x, tx) * o(y, ty)]
                if cells:
                    s, n = sum(a * v for a, v in cells), sum(a for a, _ in cells)
                    want.append(s // n + (2 * (s % n) > n or (2 * (s % n) == n and s // n % 2 == 1)))
            assert got.pop((k, ty)) == want, (k, ty)
    assert not got
    tall = spark.range(2_159_000, 2_160_000).select(F.lit("t").alias("sheet_id"), F.col("id").cast("int").alias("y"), F.unhex(F.lit("3C3C3C3CEEEEEEEE")).alias("gray"))
    last = runs.downscaled(tall, runs.page_sizes(tall), 1 << 20).agg(F.min("y"), F.max("y"), F.count("y"), F.min("gray"), F.max("gray")).first()
    assert last[:3] == (2_159_000 * (1 << 20) // 2_160_000, (1 << 20) - 1, (1 << 20) - 2_159_000 * (1 << 20) // 2_160_000) and last[3] == last[4] and len(last[3]) == 4
