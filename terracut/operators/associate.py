"""Elevation callouts joined to the nearest polyline of the preferred kind."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracut.params import DEFAULTS
from terracut.sources.scratch import kept

TOPO = ["topo", "existing", "proposed"]
#: Callouts of a tile of a sheet, and steps of a chunk of a tile, about: what one group of a task holds.
TILE_CALLOUTS, CHUNK_STEPS = 1 << 15, 1 << 17
#: Distances that agree to so many digits are ties.
DIGITS = 9
#: Steps of the first batch, how batches grow, and cells looked at in one piece.
FIRST_BATCH, GROWTH, PIECE = 64, 4, 1 << 18


def polyline_segments(points: DataFrame) -> DataFrame:
    """sheet_id, poly_seq, pos, x1, y1, x2, y2: the steps of each polyline; a lone point is a step to itself."""
    order = W.partitionBy("sheet_id", "poly_seq").orderBy("pos")
    ends = points.select("sheet_id", "poly_seq", "pos", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), F.lead(F.col("x").cast("double")).over(order).alias("x2"), F.lead(F.col("y").cast("double")).over(order).alias("y2"))
    ends = ends.where(F.col("x2").isNotNull() | (F.col("pos") == 0))
    return ends.withColumn("x2", F.coalesce("x2", "x1")).withColumn("y2", F.coalesce("y2", "y1"))


def feet(x: np.ndarray, y: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """foot_on_segment() of each place on its step (rows x1, y1, x2, y2), and the distance."""
    x1, y1, x2, y2 = steps
    vx, vy = x2 - x1, y2 - y1
    size = vx * vx + vy * vy
    point = size < 1e-9
    t = np.where(point, 0.0, np.clip(((x - x1) * vx + (y - y1) * vy) / np.where(point, 1.0, size), 0.0, 1.0))
    fx, fy = x1 + t * vx, y1 + t * vy
    return fx, fy, np.hypot(x - fx, y - fy)


class Cells:
    """Places in columns along one axis, and in cells of each column across it."""

    def __init__(self, along: np.ndarray, across: np.ndarray):
        n = len(along)
        self.a0, self.b0 = along.min(), across.min()
        wide, high = along.max() - self.a0, across.max() - self.b0
        apart = np.sqrt(max(wide, 1e-9) * max(high, 1e-9) / n)
        self.columns = int(np.clip(wide / (0.4 * apart), 1, 4 * n))
        self.rows = int(np.clip(high / (0.13 * apart), 1, 32 * n // self.columns))
        # A little wider, so that the last place stands in the last cell.
        self.w, self.h = (wide * (1 + 1e-9) + 1e-9) / self.columns, (high * (1 + 1e-9) + 1e-9) / self.rows
        column = np.minimum(((along - self.a0) / self.w).astype(np.int64), self.columns - 1)
        cell = column * self.rows + np.minimum(((across - self.b0) / self.h).astype(np.int64), self.rows - 1)
        self.order = np.argsort(cell, kind="stable")
        self.first = np.searchsorted(cell[self.order], np.arange(self.columns * self.rows + 1))
        self.column = column

    def pairs(self, steps: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and steps (rows a1, b1, a2, b2, longer along than across) that may be within the places' bounds."""
        if not steps.shape[1]:
            return
        reach = np.zeros(self.columns)
        np.maximum.at(reach, self.column, bound + 1e-6)
        # A place's cell and the line's height in the middle of its column differ by the slope over half a column.
        a1, b1, a2, b2 = steps
        flat = a1 == a2
        slope = np.where(flat, 0.0, (b2 - b1) / np.where(flat, 1.0, a2 - a1))
        far = reach.max()
        lo = np.clip(np.floor((np.minimum(a1, a2) - far - self.a0) / self.w), 0, self.columns).astype(np.int64)
        hi = np.clip(np.floor((np.maximum(a1, a2) + far - self.a0) / self.w), -1, self.columns - 1).astype(np.int64)
        count = np.maximum(hi - lo + 1, 0)
        ends = np.cumsum(count)
        at = 0
        while at < len(count):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            step = np.repeat(np.arange(at, to), count[at:to])
            column = np.arange(len(step)) - np.repeat(ends[at:to] - count[at:to] - base - lo[at:to], count[at:to])
            middle = b1[step] + slope[step] * (self.a0 + (column + 0.5) * self.w - a1[step]) - self.b0
            half = np.abs(slope[step]) * (self.w / 2 + 1e-6) + 1.4143 * reach[column]
            low = np.clip((middle - half) / self.h, 0, self.rows).astype(np.int64)
            high = np.clip((middle + half) / self.h + 1, 0, self.rows).astype(np.int64)
            start, stop = self.first[column * self.rows + low], self.first[column * self.rows + np.maximum(high, low)]
            some = np.flatnonzero(stop > start)
            # Places of these cells, in pieces as well.
            start, n, step = start[some], (stop - start)[some], step[some]
            total = np.cumsum(n)
            i = 0
            while i < len(n):
                done = total[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(total, done + PIECE, "right")))
                place = np.arange(total[j - 1] - done) + np.repeat(start[i:j] - (total[i:j] - n[i:j] - done), n[i:j])
                yield self.order[place], np.repeat(step[i:j], n[i:j])
                i = j
            at = to


def nearest_steps(x: np.ndarray, y: np.ndarray, steps: np.ndarray, farthest: float) -> np.ndarray:
    """For each place the first of its nearest steps (rows x1, y1, x2, y2), or -1 where none is within farthest.

    Steps go through the places' cells in growing batches, in no order. What a batch finds bounds the search of the next, so
    few pairs are looked at however many steps and places there are.
    """
    best, which, bound = np.full(len(x), np.inf), np.full(len(x), -1), np.full(len(x), float(farthest))
    if not len(x) or not steps.shape[1]:
        return which
    order = np.random.default_rng(5).permutation(steps.shape[1])
    steep = np.abs(steps[3] - steps[1]) > np.abs(steps[2] - steps[0])
    sides = (Cells(x, y), np.array([0, 1, 2, 3]), ~steep), (Cells(y, x), np.array([1, 0, 3, 2]), steep)
    at, size = 0, FIRST_BATCH
    while at < len(order):
        batch = order[at : at + size]
        for cells, turn, fits in sides:
            chosen = batch[fits[batch]]
            for place, step in cells.pairs(steps[turn][:, chosen], bound):
                step = chosen[step]
                far = feet(x[place], y[place], steps[:, step])[2]
                near = np.flatnonzero(far <= np.minimum(bound[place] + 2 * 10.0**-DIGITS, farthest))
                place, step, far = place[near], step[near], far[near]
                key = np.floor(far * 10.0**DIGITS + 0.5)
                least = np.lexsort((step, key, place))
                least = least[np.flatnonzero(np.diff(place[least], prepend=-1))]
                place, step, far, key = place[least], step[least], far[least], key[least]
                better = (key < best[place]) | ((key == best[place]) & (step < which[place]))
                place = place[better]
                best[place], which[place], bound[place] = key[better], step[better], np.minimum(bound[place], far[better])
        at, size = at + size, min(size * GROWTH, 1 << 16)
    return which


def nearest_in_chunk(callouts: pa.Table, steps: pa.Table, farthest: float) -> dict[str, np.ndarray]:
    """seq, key, poly_seq, pos, foot_x, foot_y, distance of the callouts of a tile that have a step of the chunk within farthest."""
    c = {k: callouts.column(k).to_numpy() for k in ("x", "y", "seq", "prefer")}
    s = {k: steps.column(k).to_numpy() for k in ("poly_seq", "pos", "x1", "y1", "x2", "y2", "style")}
    # In order of number; of equal steps only the first can be a result.
    order = np.lexsort((s["pos"], s["poly_seq"], *[s[k] for k in ("x1", "y1", "x2", "y2", "style")]))
    same = np.ones(len(order), bool)
    if len(order) > 1:
        same[1:] = np.any([np.diff(s[k][order]) != 0 for k in ("x1", "y1", "x2", "y2", "style")], axis=0)
    first = order[same]
    first = first[np.lexsort((s["pos"][first], s["poly_seq"][first]))]
    s = {k: v[first] for k, v in s.items()}
    lines, found = np.stack([s[k] for k in ("x1", "y1", "x2", "y2")]), []
    for prefer in np.unique(c["prefer"]):
        mine, own = np.flatnonzero(c["prefer"] == prefer), np.flatnonzero(s["style"] == prefer) if prefer else np.arange(len(first))
        places, back = np.unique(np.stack([c["x"][mine], c["y"][mine]]), axis=1, return_inverse=True)
        which = nearest_steps(places[0], places[1], lines[:, own], farthest)[back.reshape(-1)]
        there = which >= 0
        found.append((mine[there], own[which[there]]))
    place, step = (np.concatenate(v).astype(np.int64) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    fx, fy, far = feet(c["x"][place], c["y"][place], lines[:, step])
    return {"seq": c["seq"][place], "key": np.floor(far * 10.0**DIGITS + 0.5), "poly_seq": s["poly_seq"][step], "pos": s["pos"][step], "foot_x": fx, "foot_y": fy, "distance": far}


def associate(elevations: DataFrame, points: DataFrame, kinds: DataFrame, max_dist: float = DEFAULTS.max_dist) -> DataFrame:
    """sheet_id, seq, poly_seq, foot_x, foot_y, distance: for each callout the nearest polyline within max_dist.

    elevations: sheet_id, seq, x, y, kind. points: sheet_id, poly_seq, pos, x, y. kinds: sheet_id, poly_seq, kind. Contours
    (topo, existing, proposed) are used where a sheet has any, else all polylines. existing_match callouts look at existing
    contours alone, spots and floor levels at proposed ones, if the sheet has any at all: a preferred contour too far away
    is not replaced by another. Ties (to DIGITS digits) go to the smaller poly_seq, then to the earlier step.

    The box of a sheet's callouts is cut into tiles by their number, one on most sheets. A step goes to the tiles that it
    passes, there to one of as many chunks as the sheet has steps for; tiles meet each of their chunks in a task and give one
    row for each callout at most. So no pairs leave a task, and what is shuffled grows with steps and callouts.
    """
    has = kinds.groupBy("sheet_id").agg(*[F.coalesce(F.bool_or(F.col("kind").isin(k)), F.lit(False)).alias(name) for name, k in (("has_topo", TOPO), ("has_existing", ["existing"]), ("has_proposed", ["proposed"]))])
    finite = lambda *names: sum((F.abs(F.col(n)) < np.inf).cast("int") for n in names) == len(names)
    e = elevations.select("sheet_id", F.col("seq").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "kind").where(finite("x", "y"))
    e = kept(e, "callouts")  # read for their box and again for the search
    # One row for each sheet: the callouts' box, tiles a side and chunks of a tile.
    box = e.groupBy("sheet_id").agg(F.min("x").alias("bx0"), F.min("y").alias("by0"), F.max("x").alias("bx1"), F.max("y").alias("by1"), F.count(F.lit(1)).alias("callouts"))
    sheets = box.join(points.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("steps")), "sheet_id").join(has, "sheet_id").withColumn("side", F.ceil(F.sqrt(F.col("callouts") / TILE_CALLOUTS)).cast("long"))
    sheets = sheets.withColumn("chunks", F.ceil(F.col("steps") / (F.col("side") * CHUNK_STEPS)).cast("long"))
    for v in "xy":
        # A little wider, so that the last callout stands in the last tile.
        sheets = sheets.withColumn(f"tile_{v}", (F.col(f"b{v}1") - F.col(f"b{v}0")) * (1 + 1e-9) / F.col("side") + 1e-6)
    sheets = sheets.drop("callouts", "steps", "bx1", "by1")
    tile = lambda at, v: F.greatest(F.lit(0).cast("long"), F.least(F.col("side") - 1, F.floor((at - F.col(f"b{v}0")) / F.col(f"tile_{v}"))))
    within = lambda lo, hi, v: (hi >= F.col(f"b{v}0")) & (lo <= F.col(f"b{v}0") + F.col("side") * F.col(f"tile_{v}"))
    prefer = F.when((F.col("kind") == "existing_match") & F.col("has_existing"), 1).when(F.col("kind").isin("spot", "ffe") & F.col("has_proposed"), 2).otherwise(0)
    asked = e.join(F.broadcast(sheets), "sheet_id").select("sheet_id", tile(F.col("x"), "x").alias("tx"), tile(F.col("y"), "y").alias("ty"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "seq", "x", "y", prefer.alias("prefer"))
    style = F.when(F.col("kind") == "existing", 1).when(F.col("kind") == "proposed", 2).otherwise(0)
    usable = kinds.join(F.broadcast(has.select("sheet_id", "has_topo")), "sheet_id").where(~F.col("has_topo") | F.col("kind").isin(TOPO)).select("sheet_id", "poly_seq", style.alias("style"))
    steps = polyline_segments(points).where(finite("x1", "y1", "x2", "y2")).join(usable, ["sheet_id", "poly_seq"]).join(F.broadcast(sheets.drop("has_topo", "has_existing", "has_proposed")), "sheet_id")
    grown = max_dist + 1e-3
    x0, x1 = F.least("x1", "x2") - grown, F.greatest("x1", "x2") + grown
    steps = steps.where(within(x0, x1, "x")).withColumn("tx", F.explode(F.sequence(tile(x0, "x"), tile(x1, "x"))))
    # The part of the step in the tile's column.
    edge = F.col("bx0") + F.col("tx") * F.col("tile_x")
    height = lambda at: F.when(F.col("x1") == F.col("x2"), F.col("y1")).otherwise(F.col("y1") + (at - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    clipped = lambda at: F.least(F.greatest(at, F.least("x1", "x2")), F.greatest("x1", "x2"))
    ya, yb = height(clipped(edge - grown)), height(clipped(edge + F.col("tile_x") + grown))
    upright = F.col("x1") == F.col("x2")
    y0, y1 = F.when(upright, F.least("y1", "y2")).otherwise(F.least(ya, yb)) - grown, F.when(upright, F.greatest("y1", "y2")).otherwise(F.greatest(ya, yb)) + grown
    steps = steps.where(within(y0, y1, "y")).withColumn("ty", F.explode(F.sequence(tile(y0, "y"), tile(y1, "y"))))
    dealt = steps.select("sheet_id", "tx", "ty", F.pmod(F.xxhash64("poly_seq", "pos"), F.col("chunks")).alias("chunk"), F.col("poly_seq").cast("long").alias("poly_seq"), F.col("pos").cast("long").alias("pos"), "x1", "y1", "x2", "y2", "style")

    def meet(callouts: pa.Table, steps: pa.Table) -> pa.Table:
        found = nearest_in_chunk(callouts, steps, max_dist) if callouts.num_rows and steps.num_rows else {}
        sheet = callouts.column("sheet_id")
        n = len(found["seq"]) if found else 0
        columns = [pa.array([sheet[0].as_py()] * n, sheet.type) if n else pa.array([], kinds_of["sheet_id"])]
        return pa.table([*columns, *[pa.array(found[k] if n else [], kinds_of[k]) for k in names[1:]]], names=names)

    names = ["sheet_id", "seq", "key", "poly_seq", "pos", "foot_x", "foot_y", "distance"]
    sheet, number, line = (t.schema[k].dataType.simpleString() for t, k in ((asked, "sheet_id"), (asked, "seq"), (points, "poly_seq")))
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    kinds_of = dict(zip(names, [arrow[sheet], arrow[number], pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()], strict=True))
    by = ["sheet_id", "tx", "ty", "chunk"]
    met = asked.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(meet, f"sheet_id {sheet}, seq {number}, key double, poly_seq long, pos long, foot_x double, foot_y double, distance double")
    best = met.groupBy("sheet_id", "seq").agg(F.min(F.struct("key", "poly_seq", "pos", "foot_x", "foot_y", "distance")).alias("b"))
    return best.select("sheet_id", "seq", F.col("b.poly_seq").cast(line).alias("poly_seq"), "b.foot_x", "b.foot_y", "b.distance")


def association_rate(elevations: DataFrame, associations: DataFrame) -> DataFrame:
    """sheet_id, callouts, associated, rate."""
    n = elevations.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("callouts"))
    a = associations.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("associated"))
    return n.join(a, "sheet_id", "left").select("sheet_id", "callouts", F.coalesce("associated", F.lit(0)).alias("associated")).withColumn("rate", F.col("associated") / F.col("callouts"))
