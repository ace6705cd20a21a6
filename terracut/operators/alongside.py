"""Which polylines run along another one, found in the tasks: no pairs of polylines or points are rows.

A polyline runs along another when at least k of its samples lie near that one's vertices. Dealt to k - 1 groups, two
samples of one group are among them then, so only such pairs of samples are looked up among the other's pairs of vertices,
by the four coordinates of both, in the region of a page that the first of them stands in. What agrees in two samples is rare, however many vertices there are around each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from terracut.functions.geometry import stride
from terracut.params import Params

#: Polylines of more vertices make too many pairs of them; all samples meet their vertices in a join.
LONG = 32
#: Polylines of a region, about (a line comes by for each of its points); those of the first batch, how batches grow, and pairs looked at in one piece.
BUCKET_LINES, FIRST_BATCH, GROWTH, PIECE = 1 << 17, 2048, 8, 1 << 20
#: Polylines that a task reads before it deals them to regions.
READ_LINES = 1 << 17


def spans(start: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of all places start to start + n - 1 of each row, in pieces."""
    total, i = np.cumsum(n), 0
    while i < len(n):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + PIECE, "right")))
        row = np.repeat(np.arange(i, j), n[i:j])
        yield row, np.arange(total[j - 1] - done) + (start - (total - n - done))[row]
        i = j


def least_hits(samples: np.ndarray, share: float) -> np.ndarray:
    """The least whole number, 1 at least, whose part of the samples is the share or more."""
    k = np.ceil(share * samples)
    k = np.where((k - 1) / samples >= share, k - 1, k)
    return np.maximum(np.where(k / samples < share, k + 1, k), 1).astype(np.int64)


def alongside(owner: np.ndarray, xy: np.ndarray, sample: np.ndarray, vertex: np.ndarray, here: np.ndarray, least: np.ndarray, reach: float) -> np.ndarray:
    """Whether each line has its least number of samples within reach of another line's vertices; only pairs of samples of
    one group are looked at whose first one is here.

    owner, xy, sample, vertex, here: the points in order of lines. least: for each line.
    """
    found = np.zeros(len(least), bool)
    # Pairs of samples of one group; a sample with itself where one is enough.
    s = np.flatnonzero(sample)
    own = owner[s]
    size = np.bincount(own, minlength=len(least))
    first = np.cumsum(size) - size
    groups = np.maximum(least - 1, 1)[own]
    group = (np.arange(len(s)) - first[own]) * groups // size[own]
    pairs = [np.stack([s, s])[:, (least[own] == 1) & here[s]]]
    for apart in range(1, int(size.max(initial=0))):
        same = (own[apart:] == own[:-apart]) & (group[apart:] == group[:-apart]) & (least[own[apart:]] > 1)
        if not same.any():
            break
        pairs.append(np.stack([s[:-apart], s[apart:]])[:, same & here[s[:-apart]]])
    p = np.concatenate(pairs, axis=1)
    p = p[:, least[owner[p[0]]] <= size[owner[p[0]]]]
    v = np.flatnonzero(vertex)
    if not p.shape[1] or not len(v):
        return found
    low = np.concatenate([xy[p[i]].min(axis=0) for i in (0, 1)]) - reach
    high = np.concatenate([xy[p[i]].max(axis=0) for i in (0, 1)]) + reach
    cell = 2 * reach
    many = ((high - low)[:3] // cell).astype(np.int64) + 2
    weight = np.array([many[1] * many[2], many[2], 1])
    # Keys are cells of three coordinates, and within them the fourth.
    width = float(high[3] - low[3]) + 4 * reach
    count = np.bincount(owner[v], minlength=len(least))
    begin = np.cumsum(count) - count
    # Looked up in order of cells.
    centre = np.concatenate([xy[p[0]], xy[p[1]]], axis=1)
    order = np.argsort(np.maximum((centre[:, :3] - low[:3] - reach) // cell, 0) @ weight, kind="stable")
    p, centre = p[:, order], centre[order]
    lines = np.random.default_rng(9).permutation(np.flatnonzero(count))
    turn = np.empty(len(least), np.int64)
    turn[lines] = np.arange(len(lines))
    at, n = 0, FIRST_BATCH
    while at < len(lines) and p.shape[1]:
        mine = v[(turn[owner[v]] >= at) & (turn[owner[v]] < at + n)]
        inside = [mine[np.all((xy[mine] >= low[2 * i : 2 * i + 2]) & (xy[mine] <= high[2 * i : 2 * i + 2]), axis=1)] for i in (0, 1)]
        # All vertices b that the line of each vertex a near here has.
        lo, hi = np.searchsorted(owner[inside[1]], owner[inside[0]], "left"), np.searchsorted(owner[inside[1]], owner[inside[0]], "right")
        q = [np.stack([inside[0][row], inside[1][place]]) for row, place in spans(lo, hi - lo)]
        if q:
            q = np.concatenate(q, axis=1)
            key = ((xy[q[0]] - low[:2]) // cell @ weight[:2] + (xy[q[1], 0] - low[2]) // cell) * width + (xy[q[1], 1] - low[3])
            order = np.argsort(key, kind="stable")
            q, key = q[:, order], key[order]
            x1, y1, x2, y2, other_line = xy[q[0], 0], xy[q[0], 1], xy[q[1], 0], xy[q[1], 1], owner[q[0]]
            lower, upper = np.maximum((centre[:, :3] - low[:3] - reach) // cell, 0), (centre[:, :3] - low[:3] + reach) // cell
            from_y = centre[:, 3] - low[3] - reach * (1 + 1e-6)
            for corner in range(8):
                side = np.array([corner >> 2 & 1, corner >> 1 & 1, corner & 1], bool)
                there = np.flatnonzero(np.all((upper > lower) | ~side, axis=1) & ~found[owner[p[0]]])
                base = np.where(side, upper[there], lower[there]) @ weight * width + from_y[there]
                start, stop = np.searchsorted(key, base, "left"), np.searchsorted(key, base + 2 * reach * (1 + 1e-6), "right")
                for row, place in spans(start, stop - start):
                    # Coordinate by coordinate, so that most are left out early.
                    r = there[row]
                    for c, other in enumerate((x1, y1, x2)):
                        near = np.abs(centre[r, c] - other[place]) < reach
                        r, place = r[near], place[near]
                    fits = (owner[p[0, r]] != other_line[place]) & ~found[owner[p[0, r]]]
                    r, place = r[fits], place[fits]
                    near = (np.hypot(centre[r, 0] - x1[place], centre[r, 1] - y1[place]) < reach) & (np.hypot(centre[r, 2] - x2[place], centre[r, 3] - y2[place]) < reach)
                    line, other = owner[p[0, r[near]]], other_line[place[near]]
                    found[line[least[line] <= 2]] = True
                    more = least[line] > 2
                    met = np.unique(line[more] * len(least) + other[more])
                    line, other = met // len(least), met % len(least)
                    hits = np.zeros(len(line), np.int64)
                    # Each sample of the line with all vertices of the other.
                    for which, at_sample in spans(first[line], size[line]):
                        one = np.zeros(len(which), bool)
                        for k, at_vertex in spans(begin[other[which]], count[other[which]]):
                            one[k[np.hypot(*(xy[s[at_sample[k]]] - xy[v[at_vertex]]).T) < reach]] = True
                        np.add.at(hits, which[one], 1)
                    found[line[hits >= least[line]]] = True
        open_ = ~found[owner[p[0]]]
        p, centre = p[:, open_], centre[open_]
        at, n = at + n, n * GROWTH
    return found


def lines_of(points: DataFrame, params: Params) -> DataFrame:
    """sheet_id, poly_seq, n, step, samples, points (pos, x, y) of the polylines of at least two points."""
    place = F.struct(F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    lines = points.groupBy("sheet_id", "poly_seq").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(place)).alias("points")).where("n >= 2")
    step = stride(F.col("n"), params.redundant_samples)
    return lines.select("sheet_id", "poly_seq", "n", step.cast("long").alias("step"), F.ceil(F.col("n") / step).alias("samples"), "points")


def packed(v: np.ndarray) -> bytes:
    """Coordinates in single precision where that changes none of them; the length tells which."""
    small = v.astype(np.float32)
    return (small if np.array_equal(small, v) else v).tobytes()


def beside_short_ones(lines: DataFrame, params: Params) -> DataFrame:
    """sheet_id, poly_seq of the lines_of() that run along one of at most LONG vertices; a line may come several times.

    The box of a sheet's points is cut into regions. A line goes to those that it has points in or near, whole, so a region
    knows all about the lines that come by, and each pair of a line's samples is looked up where the first of them stands. Lines
    that go to one region travel in one row, packed, as many as a task has read.
    """
    reach = float(params.redundant_reach)
    flat = lines.select("sheet_id", F.explode("points").alias("p"))
    known = (F.abs("p.x") < np.inf) & (F.abs("p.y") < np.inf)
    box = flat.where(known).groupBy("sheet_id").agg(F.min("p.x").alias("bx0"), F.min("p.y").alias("by0"), F.max("p.x").alias("bx1"), F.max("p.y").alias("by1"), F.count(F.lit(1)).alias("points"))
    side = F.ceil(F.sqrt(F.col("points") / BUCKET_LINES)).cast("long")
    sheets = box.select("sheet_id", side.alias("side"), "bx0", "by0", *[F.greatest((F.col(f"b{v}1") - F.col(f"b{v}0")) * (1 + 1e-9) / side, F.lit(1e-6)).alias(f"tile_{v}") for v in "xy"])
    grown = reach + 1e-6
    schema = lines.select("sheet_id").schema.add("region", "long").add("poly_seq", ArrayType(lines.schema["poly_seq"].dataType))
    for c in ("n", "samples", "kind", "xy"):
        schema = schema.add(c, "binary")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[pa.RecordBatch] = []
        for batch in batches:
            read.append(batch)
            if sum(b.num_rows for b in read) >= READ_LINES:
                yield from dealt_rows(pa.Table.from_batches(read).combine_chunks())
                read = []
        if read:
            yield from dealt_rows(pa.Table.from_batches(read).combine_chunks())

    def dealt_rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        column = lambda c: t[c].to_numpy()
        points = t["points"].combine_chunks()
        places, n = points.flatten(), points.value_lengths().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(t.num_rows), n)
        pos, x, y = (places.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        sampled, short = pos % column("step")[owner] == 0, column("n") <= LONG
        use = np.isfinite(x) & np.isfinite(y) & (short[owner] | sampled)
        owner, x, y, sampled = owner[use], x[use], y[use], sampled[use]
        n = np.bincount(owner, minlength=t.num_rows)
        begin = np.cumsum(n) - n
        sides = column("side")[owner]
        tile = lambda v, at: np.clip(np.floor((at - column(f"b{v}0")[owner]) / column(f"tile_{v}")[owner]), 0, sides - 1).astype(np.int64)
        far = np.where(short[owner], grown, 0.0)
        (xa, xb), (ya, yb) = ((tile(v, at - far), tile(v, at + far)) for v, at in (("x", x), ("y", y)))
        home, kind = tile("x", x) * sides + tile("y", y), sampled + 2 * short[owner]
        wide = xb - xa + 1
        # Each line once for each region that it has points in or near.
        number = wide * (yb - ya + 1)
        point = np.repeat(np.arange(len(owner)), number)
        k = np.arange(len(point)) - np.repeat(np.cumsum(number) - number, number)
        sheet = t["sheet_id"].combine_chunks().dictionary_encode()
        code = sheet.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        region = (xa[point] + k % wide[point]) * sides[point] + ya[point] + k // wide[point]
        many = int(region.max(initial=0)) + 1
        both = np.unique((code[owner[point]] * many + region) * t.num_rows + owner[point])
        at_region, of_line = np.divmod(both, t.num_rows)
        starts = np.flatnonzero(np.concatenate([[True], at_region[1:] != at_region[:-1]])) if len(both) else []
        keys = t["poly_seq"].combine_chunks()
        out: dict[str, list] = {c: [] for c in ("sheet", "region", "of", "n", "samples", "kind", "xy")}
        for a, b in zip(starts, [*starts[1:], len(both)], strict=True):
            of = of_line[a:b]
            at = np.repeat(begin[of] - (np.cumsum(n[of]) - n[of]), n[of]) + np.arange(n[of].sum())
            out["sheet"].append(at_region[a] // many)
            out["region"].append(at_region[a] % many)
            out["of"].append(of)
            out["n"].append(n[of].astype(np.int32).tobytes())
            out["samples"].append(column("samples")[of].astype(np.int32).tobytes())
            # Of each point whether it is a sample, a vertex, and stands here.
            out["kind"].append((kind[at] + 4 * (home[at] == at_region[a] % many)).astype(np.uint8).tobytes())
            out["xy"].append(packed(np.stack([x[at], y[at]], axis=1)))
        for i in range(0, len(out["of"]), 256):
            part = {c: v[i : i + 256] for c, v in out.items()}
            size = np.array([len(v) for v in part["of"]])
            seqs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), keys.take(pa.array(np.concatenate(part["of"]))))
            yield pa.RecordBatch.from_arrays([sheet.dictionary.take(pa.array(part["sheet"])), pa.array(part["region"], pa.int64()), seqs, *[pa.array(part[c], pa.binary()) for c in ("n", "samples", "kind", "xy")]], ["sheet_id", "region", "poly_seq", "n", "samples", "kind", "xy"])

    def look(bucket: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in bucket[c].to_pylist()])
        n, samples, kind = read("n", np.int32), read("samples", np.int32), read("kind", np.uint8)
        xy = np.concatenate([np.frombuffer(b, np.float32 if len(b) == 8 * len(k) else np.float64).astype(float) for b, k in zip(bucket["xy"].to_pylist(), bucket["kind"].to_pylist(), strict=True)]).reshape(-1, 2)
        owner = np.repeat(np.arange(len(n)), n)
        found = alongside(owner, xy, kind & 1 > 0, kind & 2 > 0, kind & 4 > 0, least_hits(samples.astype(np.int64), params.redundant_share), reach)
        seqs = bucket["poly_seq"].combine_chunks().flatten().filter(pa.array(found))
        return pa.table({"sheet_id": bucket["sheet_id"].combine_chunks()[:1].take(pa.array(np.zeros(len(seqs), np.int64))), "poly_seq": seqs})

    kinds = ", ".join(f"{k} {lines.schema[k].dataType.simpleString()}" for k in ("sheet_id", "poly_seq"))
    dealt = lines.join(F.broadcast(sheets), "sheet_id").mapInArrow(deal, schema)
    return dealt.groupBy("sheet_id", "region").applyInArrow(look, kinds)
