"""Heights at grid nodes from scattered points, node by node: no triangulation is made, only the triangles that nodes lie in.

Raised to the square of its distance from a node, a surface's points have a lower hull whose facet at the node is the
node's Delaunay triangle. It is found by exchanging corners: any triangle around the node is bettered by the point deepest
in its circle, until the circle is empty. Points near the node mostly settle it, and who owns which points does
not matter otherwise: a circle that leaves a task's points is emptied by the tasks of those tiles that it touches. The
work grows with nodes and with the reading of points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracut.sources.scratch import kept

#: Points of a surface for each tile, about; how far a tile's points reach into those around it, as a share of its side.
TILE_POINTS, HALO = 1 << 15, 0.25
#: Points of a bucket within a task, about; candidates of several nodes put together, and looked at together; what rounding may do to a height.
BUCKET_POINTS, PIECE, CELLS, NOISE = 4, 1 << 21, 1 << 18, 3e-14
CORNERS = [f"{c}{k}" for k in "abc" for c in ("x", "y", "z", "seq")]


def plane(x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, c of the planes h = a x + b y + c through rows of three points; not finite where they lie on a line."""
    x1, x2, y1, y2, h1, h2 = x[:, 1] - x[:, 0], x[:, 2] - x[:, 0], y[:, 1] - y[:, 0], y[:, 2] - y[:, 0], h[:, 1] - h[:, 0], h[:, 2] - h[:, 0]
    det = x1 * y2 - x2 * y1
    with np.errstate(all="ignore"):
        a, b = (h1 * y2 - h2 * y1) / det, (x1 * h2 - x2 * h1) / det
        return a, b, h[:, 0] - a * x[:, 0] - b * y[:, 0]


def shares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The origin's weights on rows of three points."""
    w = np.stack([x[:, 1] * y[:, 2] - x[:, 2] * y[:, 1], x[:, 2] * y[:, 0] - x[:, 0] * y[:, 2], x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0]], axis=1)
    with np.errstate(all="ignore"):
        return w / w.sum(axis=1, keepdims=True)


def lowest(x: np.ndarray, y: np.ndarray, h: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of points (those that are ok) the three of them whose plane is lowest at the origin, of all planes with no point below.

    Columns of the three, their plane, and which rows have one: those with the origin among their points' triangles.
    """
    row = np.arange(len(x))
    d2 = np.where(ok, x * x + y * y, np.inf)
    a = d2.argmin(axis=1)
    ax, ay = x[row, a][:, None], y[row, a][:, None]
    turn = np.where(ok, np.arctan2(ax * y - ay * x, ax * x + ay * y), 0.0)
    side = np.where(ok, np.abs(np.sin(turn)), -1.0).argmax(axis=1)
    b, c = turn.argmax(axis=1), turn.argmin(axis=1)
    has = (turn[row, b] - turn[row, c] >= np.pi - 1e-7) & (d2[row, a] > 0)
    # The origin on the line of two points: a third one on either side.
    b, c = np.where(turn[row, b] <= 0, side, b), np.where(turn[row, c] >= 0, side, c)
    t = np.stack([a, b, c], axis=1)
    of = lambda v, r, t: v[r[:, None], t]
    p = np.stack(plane(of(x, row, t), of(y, row, t), of(h, row, t)), axis=1)
    has &= np.isfinite(p).all(axis=1) & (shares(of(x, row, t), of(y, row, t)).min(axis=1) > -1e-6)
    go = np.flatnonzero(has)
    for _ in range(1000):
        if not len(go):
            break
        below, scale = depth(x[go], y[go], h[go], p[go])
        below = np.where(ok[go], below, np.inf)
        np.put_along_axis(below, t[go], np.inf, axis=1)
        new = below.argmin(axis=1)
        k = np.arange(len(go))
        worse = below[k, new] < -NOISE * scale[k, new]
        go, new = go[worse], new[worse]
        if not len(go):
            break
        options = [np.where(np.arange(3) == i, new[:, None], t[go]) for i in range(3)]
        fits = np.stack([np.nan_to_num(shares(of(x, go, o), of(y, go, o)).min(axis=1), nan=-np.inf, posinf=-np.inf) for o in options], axis=1)
        best = np.stack(options, axis=1)[np.arange(len(go)), fits.argmax(axis=1)]
        lower = np.stack(plane(of(x, go, best), of(y, go, best), of(h, go, best)), axis=1)
        better = np.isfinite(lower).all(axis=1) & (lower[:, 2] < p[go, 2])
        go, best, lower = go[better], best[better], lower[better]
        t[go], p[go] = best, lower
    return t, p, has


def depth(x: np.ndarray, y: np.ndarray, h: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far points lie above their row's plane, and the size of the numbers that this is the difference of."""
    u, v, w = p[:, 0:1] * x, p[:, 1:2] * y, p[:, 2:3]
    return h - (u + v + w), np.abs(h) + np.abs(u) + np.abs(v) + np.abs(w)


def padded(start: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places, which are places) for rows of n places from start, rows of similar length together."""
    order, i = np.argsort(n, kind="stable"), 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * n[order[j]] <= CELLS:
            j += max(1, min(len(order) - j, CELLS // max(1, int(n[order[j]])) - (j - i)) // 8)
        j = min(j, len(order))
        r = order[i:j]
        k = np.arange(max(1, n[r].max()))
        ok = k < n[r][:, None]
        yield r, np.where(ok, start[r][:, None] + k, 0), ok
        i = j


Parts = tuple[np.ndarray, np.ndarray, np.ndarray]  # owner (in order), first place and number of places of each part


def pieces(m: int, parts: Parts, more: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(owners, start, n, places) of the m owners in pieces: all places of an owner's parts, put together, and its row of more."""
    owner, first, n = parts
    if more is not None:
        order = np.argsort(np.concatenate([owner, np.arange(m)]), kind="stable")
        # Rows of more stand before all places here, as negative ones.
        wide = more.shape[1]
        owner, first, n = (np.concatenate(v)[order] for v in ((owner, np.arange(m)), (first, wide * np.arange(-m, 0)), (n, np.full(m, wide))))
    total = np.bincount(owner, n, m).astype(np.int64)
    upto, i = np.cumsum(total), 0
    while i < m:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PIECE, "right")))
        a, b = np.searchsorted(owner, (i, j))
        f, c = first[a:b], n[a:b]
        places = np.repeat(f - (np.cumsum(c) - c), c) + np.arange(c.sum())
        if more is not None:
            ahead = np.flatnonzero(places < 0)
            row, column = np.divmod(places[ahead] + wide * m, wide)
            places[ahead] = more[row, column]
        yield np.arange(i, j), upto[i:j] - total[i:j] - (upto[i - 1] if i else 0), total[i:j], places
        i = j


class Heights:
    """Points of a task in buckets. known: the box (x0, y0, x1, y1) whose points are all here; site: that of all points."""

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, seq: np.ndarray, known: tuple[float, ...], site: tuple[float, ...]):
        self.site = np.array(site, float)
        self.known = np.where([known[0] <= site[0], known[1] <= site[1], known[2] >= site[2], known[3] >= site[3]], [-np.inf, -np.inf, np.inf, np.inf], known)
        self.x0, self.y0 = x.min(), y.min()
        wide, high = max(float(np.ptp(x)), 1e-9), max(float(np.ptp(y)), 1e-9)
        self.cell = max(np.sqrt(wide * high / len(x) * BUCKET_POINTS), max(wide, high) / len(x) * BUCKET_POINTS, 1e-9)
        self.nx, self.ny = int(wide // self.cell) + 1, int(high // self.cell) + 1
        home = self.column(x) + self.nx * self.line(y)
        order = np.lexsort((seq, y, x, home))
        self.x, self.y, self.z, self.seq = x[order], y[order], z[order], seq[order]
        self.first = np.searchsorted(home[order], np.arange(self.nx * self.ny + 1))

    def column(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.x0) / self.cell), 0, self.nx - 1).astype(np.int64)

    def line(self, y: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((y - self.y0) / self.cell), 0, self.ny - 1).astype(np.int64)

    def parts(self, owner: np.ndarray, line: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Parts:
        a = self.first[line * self.nx + lo]
        return owner, a, np.maximum(self.first[line * self.nx + hi + 1] - a, 0)

    def around(self, qx: np.ndarray, qy: np.ndarray, ring: int) -> tuple[Parts, np.ndarray]:
        """The points of the buckets up to `ring` away from each node, and the boxes in which these are all points."""
        c, r = self.column(qx), self.line(qy)
        owner = np.repeat(np.arange(len(qx)), 2 * ring + 1)
        line = (r[:, None] + np.arange(-ring, ring + 1)).ravel()
        there = (line >= 0) & (line < self.ny)
        owner, line = owner[there], line[there]
        lo, hi = np.maximum(c - ring, 0), np.minimum(c + ring, self.nx - 1)
        side = lambda v, n, far: np.where(v <= 0 if far < 0 else v >= n - 1, far, 0.0)
        box = np.stack([self.x0 + (c - ring) * self.cell + side(c - ring, self.nx, -np.inf), self.y0 + (r - ring) * self.cell + side(r - ring, self.ny, -np.inf), self.x0 + (c + ring + 1) * self.cell + side(c + ring, self.nx, np.inf), self.y0 + (r + ring + 1) * self.cell + side(r + ring, self.ny, np.inf)], axis=1)
        # Rounding may put a point on a bucket's edge into the next one.
        box[:, :2] += 1e-9 * self.cell * (1 + ring)
        box[:, 2:] -= 1e-9 * self.cell * (1 + ring)
        box = np.concatenate([np.maximum(box[:, :2], self.known[:2]), np.minimum(box[:, 2:], self.known[2:])], axis=1)
        return self.parts(owner, line, lo[owner], hi[owner]), box

    def within(self, mx: np.ndarray, my: np.ndarray, r2: np.ndarray) -> Parts:
        """The points of the buckets that each circle touches."""
        r = np.sqrt(np.maximum(r2, 0)) * (1 + 1e-12) + 1e-9 * self.cell
        a, b = self.line(my - r), self.line(my + r)
        owner = np.repeat(np.arange(len(mx)), b - a + 1)
        line = np.arange(len(owner)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1) + a[owner]
        low = self.y0 + line * self.cell
        off = np.maximum(0, np.maximum(low - my[owner], my[owner] - low - self.cell) - 1e-9 * self.cell)
        half = np.sqrt(np.maximum((r[owner] - off) * (r[owner] + off), 0)) + 1e-9 * self.cell
        return self.parts(owner, line, self.column(mx[owner] - half), self.column(mx[owner] + half))

    def complete(self, box: np.ndarray, mx: np.ndarray, my: np.ndarray, r2: np.ndarray) -> np.ndarray:
        """Which circles, as far as they lie in the site's box, lie in the boxes."""
        r = np.sqrt(np.maximum(r2, 0)) * (1 + 1e-9)
        lo, hi = np.stack([mx - r, my - r], axis=1), np.stack([mx + r, my + r], axis=1)
        return ((lo >= box[:, :2]) | (self.site[:2] >= box[:, :2])).all(axis=1) & ((hi <= box[:, 2:]) | (self.site[2:] <= box[:, 2:])).all(axis=1)


Facets = dict[str, np.ndarray]


def nothing(qx: np.ndarray, qy: np.ndarray) -> Facets:
    m = len(qx)
    return {"t": np.full((m, 3), -1), "z": np.full(m, np.nan), "mx": qx + 0.0, "my": qy + 0.0, "r2": np.full(m, np.inf), "has": np.zeros(m, bool)}


def best_facets(qx: np.ndarray, qy: np.ndarray, sx: np.ndarray, sy: np.ndarray, p: tuple[np.ndarray, ...], parts: Parts, more: np.ndarray | None = None) -> tuple[Facets, np.ndarray, np.ndarray]:
    """For nodes and their candidates among the points p (x, y, z, seq): the triangle (three places), height, circle and whether
    there is one; and all candidates on these circles, as numbers of nodes and places.

    Of several triangles on one circle, that of the least height counts. Triangles are those around a place sx, sy off the node,
    next to nothing, so that no node stands on a line of points; heights are those at the node.
    """
    out, nodes, on_circle = nothing(qx, qy), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for owners, start, n, places in pieces(len(qx), parts, more):
        if not len(places):
            continue
        for rows, at, ok in padded(start, n):
            c, rows = places[at], owners[rows]
            x, y, z = p[0][c] - (qx + sx)[rows][:, None], p[1][c] - (qy + sy)[rows][:, None], p[2][c]
            h = x * x + y * y
            t, f, has = lowest(x, y, h, ok)
            k = np.arange(len(rows))
            at_node = ok & (p[0][c] == qx[rows][:, None]) & (p[1][c] == qy[rows][:, None])
            here, same = at_node.argmax(axis=1), at_node.any(axis=1)
            t[same] = here[same, None]
            r = np.flatnonzero(has & ~same)
            f = np.where((has & ~same)[:, None], f, 0.0)
            height = np.where(same, z[k, here], np.nan)
            on = r[:, None], t[r]
            height[r] = (shares(x[on] + sx[rows[r]][:, None], y[on] + sy[rows[r]][:, None]) * z[on]).sum(axis=1)
            below, scale = depth(x[r], y[r], h[r], f[r])
            ring = ok[r] & (below <= NOISE * scale)
            np.put_along_axis(ring, t[r], True, axis=1)
            tied = np.flatnonzero(ring.sum(axis=1) > 3)
            if len(tied):
                s = r[tied]
                _, g, flat = lowest(x[s], y[s], z[s], ring[tied])
                height[s[flat]] = np.fmin(height[s[flat]], (g[:, 2] - g[:, 0] * sx[rows[s]] - g[:, 1] * sy[rows[s]])[flat])
            a, b = np.nonzero(ring)
            nodes.append(rows[r[a]])
            on_circle.append(c[r[a], b])
            found = has | same
            out["t"][rows] = np.where(found[:, None], c[k[:, None], t], -1)
            out["z"][rows], out["has"][rows] = height, found
            out["mx"][rows], out["my"][rows] = (qx + sx)[rows] + f[:, 0] / 2, (qy + sy)[rows] + f[:, 1] / 2
            out["r2"][rows] = np.where(found, f[:, 2] + (f[:, 0] ** 2 + f[:, 1] ** 2) / 4, np.inf)
    return out, np.concatenate(nodes), np.concatenate(on_circle)


def nearest_of(qx: np.ndarray, qy: np.ndarray, p: tuple[np.ndarray, ...], parts: Parts) -> tuple[np.ndarray, np.ndarray]:
    """The candidate nearest to each node (of the smallest seq among equals; -1: none) and its squared distance."""
    best, d = np.full(len(qx), -1), np.full(len(qx), np.inf)
    for owners, start, n, places in pieces(len(qx), parts):
        if not len(places):
            continue
        for rows, at, ok in padded(start, n):
            c, rows = places[at], owners[rows]
            d2 = np.where(ok, (qx[rows][:, None] - p[0][c]) ** 2 + (qy[rows][:, None] - p[1][c]) ** 2, np.inf)
            least = d2.min(axis=1)
            first = np.where(d2 == least[:, None], p[3][c], np.iinfo(np.int64).max).argmin(axis=1)
            some = ok.any(axis=1)
            best[rows[some]] = c[np.arange(len(rows)), first][some]
            d[rows[some]] = least[some]
    return best, d


def hull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the points of the lower and of the upper chain of the convex hull, from left to right."""
    order = np.lexsort((y, x))
    chains = []
    for sign in (1, -1):
        # Of points of one x only the outermost count.
        o = order if sign > 0 else np.lexsort((-y, x))
        o = o[np.concatenate([[True], x[o][1:] != x[o][:-1]])]
        xs, ys, side = x[o].tolist(), (sign * y[o]).tolist(), []
        for k in range(len(o)):
            while len(side) > 1 and (xs[side[-1]] - xs[side[-2]]) * (ys[k] - ys[side[-2]]) <= (ys[side[-1]] - ys[side[-2]]) * (xs[k] - xs[side[-2]]):
                side.pop()
            side.append(k)
        chains.append(o[side])
    return chains[0], chains[1]


def power(qx: np.ndarray, qy: np.ndarray, f: Facets, less: bool = False) -> np.ndarray:
    """The height of a circle's plane at the node; less: by what rounding may do."""
    u, v = f["mx"] - qx, f["my"] - qy
    return f["r2"] - (u * u + v * v) - (1e-12 * (np.abs(f["r2"]) + u * u + v * v) if less else 0.0)


def heights(qx: np.ndarray, qy: np.ndarray, own: Heights, rim: tuple[np.ndarray, ...]) -> tuple[Facets, tuple[np.ndarray, ...]]:
    """Height of each node: on its triangle within the hull, that of the nearest point outside; and the points that t numbers.

    rim: x, y, z, seq of the points of the site's hull. open: other tasks' points may matter; t (corners, or the nearest point
    three times) and the circle are then the best so far.
    """
    p = tuple(np.concatenate([a, b]) for a, b in zip((own.x, own.y, own.z, own.seq), rim, strict=True))
    lower, upper = hull(rim[0], rim[1])
    room = 1e-9 * max(np.ptp(rim[0]), np.ptp(rim[1]), 1.0)
    side = lambda chain: np.interp(qx, rim[0][chain], rim[1][chain])
    inside = (qx >= rim[0].min() - room) & (qx <= rim[0].max() + room) & (qy >= side(lower) - room) & (qy <= side(upper) + room)
    out = nothing(qx, qy) | {"open": np.zeros(len(qx), bool)}
    of = lambda k: {c: out[c][k] for c in ("mx", "my", "r2")}
    # Aside, towards a place within the hull that stands on no line of points.
    order = np.lexsort((rim[1], rim[0]))
    weight = 1 + (np.arange(len(order)) * 0.6180339887) % 1
    ax, ay = (np.average(rim[c][order], weights=weight) - q for c, q in ((0, qx), (1, qy)))
    far = np.maximum(np.hypot(ax, ay), 1e-300)
    aside = 1e-11 * max(np.ptp(rim[0]), np.ptp(rim[1])) + 4e-15 * max(np.abs(rim[0]).max(), np.abs(rim[1]).max())
    sx, sy = ax / far * aside, ay / far * aside
    left = np.flatnonzero(inside)
    every = np.arange(len(own.x), len(p[0]))
    for ring, more in ((1, every[:0]), (4, every[:0]), (1, every[:: len(every) // 64 + 1]), (1, every)):
        parts, box = own.around(qx[left], qy[left], ring)
        f, _, _ = best_facets(qx[left], qy[left], sx[left], sy[left], p, parts, np.broadcast_to(more, (len(left), len(more))) if len(more) else None)
        f["open"] = f["has"] & (f["r2"] > 0) & ~own.complete(box, **{c: f[c] for c in ("mx", "my", "r2")})
        for c, v in f.items():
            out[c][left] = v
        left = left[~f["has"]]
    inside[left] = False
    # Circles that leave the buckets looked at are emptied of the points in them.
    left = np.flatnonzero(out["open"])
    while len(left):
        f, _, _ = best_facets(qx[left], qy[left], sx[left], sy[left], p, own.within(**of(left)), out["t"][left])
        moved = f["has"] & (power(qx[left] + sx[left], qy[left] + sy[left], f) < power(qx[left] + sx[left], qy[left] + sy[left], of(left), True))
        out["open"][left] = ~own.complete(np.broadcast_to(own.known, (len(left), 4)), **of(left))
        for c, v in f.items():
            out[c][left[f["has"]]] = v[f["has"]]
        left = left[moved]
    left, ring = np.flatnonzero(~inside), 2
    while len(left):
        parts, box = own.around(qx[left], qy[left], ring)
        best, d = nearest_of(qx[left], qy[left], p, parts)
        done = (best >= 0) & own.complete(box, qx[left], qy[left], d)
        out["t"][left], out["r2"][left], out["open"][left] = best[:, None], d, ~done
        out["mx"][left], out["my"][left], out["z"][left] = qx[left], qy[left], np.where(best >= 0, p[2][best], np.nan)
        left, ring = left[~done & (ring < max(own.nx, own.ny))], 2 * ring
    return out | {"inside": inside, "sx": sx, "sy": sy}, p


def placed(samples: DataFrame) -> DataFrame:
    """samples (site_id, surface, x, y, z, seq: each place once) with lo_x, lo_y, hi_x, hi_y, k (tiles a side) of their surface."""
    keys = ["site_id", "surface"]
    box = samples.groupBy(*keys).agg(F.min("x").alias("lo_x"), F.min("y").alias("lo_y"), F.max("x").alias("hi_x"), F.max("y").alias("hi_y"), F.greatest(F.lit(1), F.floor(F.sqrt(F.count(F.lit(1)) / TILE_POINTS))).cast("int").alias("k"))
    return samples.join(box, keys)


def tile(v: str, more: float = 0.0, at: str | None = None) -> Column:
    """The tile of a place along an axis; more: of the place as many tiles farther."""
    lo, hi = F.col(f"lo_{v}"), F.col(f"hi_{v}")
    return F.when(hi > lo, F.greatest(F.lit(0), F.least(F.col("k") - 1, F.floor((F.col(at or v) - lo) / (hi - lo) * F.col("k") + more)))).otherwise(0).cast("int")


def on_grid(samples: DataFrame, extent: DataFrame, grid_n: int) -> DataFrame:
    """site_id, surface, i, j, z at every node of each surface's grid: on the triangle around it, or of the nearest sample outside of all.

    samples: site_id, surface, x, y, z, seq, each place of a surface once. extent: site_id, x0, y0, dx, dy. A surface is cut into
    tiles of some TILE_POINTS points; tasks take a tile's nodes with the points of the tile and a rim around it. Circles that
    reach farther, mostly near the surface's edge, are looked through in rounds by the tiles that they touch.
    """
    keys, kind = ["site_id", "surface"], samples.schema["site_id"].dataType.simpleString()
    known = (F.abs("x") < np.inf) & (F.abs("y") < np.inf)
    points = kept(placed(samples.where(known)).withColumns({"ti": tile("x"), "tj": tile("y")}), "placed")
    head = f"site_id {kind}, surface string"
    fields = f"{head}, x double, y double, z double, seq long"

    def outer(s: pd.DataFrame) -> pd.DataFrame:
        return s.iloc[np.unique(np.concatenate(hull(s.x.to_numpy(), s.y.to_numpy())))][[*keys, "x", "y", "z", "seq"]]

    large = points.where("k > 1")
    rims = large.groupBy(*keys, "ti", "tj").applyInPandas(outer, fields).groupBy(*keys).applyInPandas(outer, fields)
    sides = large.select(*keys, "lo_x", "lo_y", "hi_x", "hi_y", "k").distinct()
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    rims = rims.join(sides, keys).withColumn("to_i", every).withColumn("to_j", every).withColumn("rim", F.lit(True))
    reach = lambda v: F.explode(F.sequence(tile(v, -HALO), tile(v, HALO)))
    dealt = points.drop("ti", "tj").withColumn("to_i", reach("x")).withColumn("to_j", reach("y")).withColumn("rim", F.lit(False)).unionByName(rims)
    grids = extent.select("site_id", "x0", "y0", "dx", "dy")
    rows = f"{head}, i int, j int, x double, y double, z double, sx double, sy double, open boolean, inside boolean, mx double, my double, r2 double, {', '.join(f'{c} {"long" if c[0] == "s" else "double"}' for c in CORNERS)}"

    def table(s: pd.DataFrame, i: np.ndarray, j: np.ndarray, qx: np.ndarray, qy: np.ndarray, f: Facets, p: tuple[np.ndarray, ...]) -> pd.DataFrame:
        corner = {f"{n}{k}": v[f["t"][:, c]] for c, k in enumerate("abc") for n, v in zip(("x", "y", "z", "seq"), p, strict=True)}
        return pd.DataFrame({"site_id": s.site_id.iloc[0], "surface": s.surface.iloc[0], "i": i, "j": j, "x": qx, "y": qy} | {c: f[c] for c in ("z", "sx", "sy", "open", "inside", "mx", "my", "r2")} | corner)

    def look(s: pd.DataFrame) -> pd.DataFrame:
        a = s.iloc[0]
        n = np.arange(grid_n)
        part = lambda v, lo, hi: np.clip(np.floor((v - lo) / (hi - lo) * a.k), 0, a.k - 1) if hi > lo else np.zeros(len(v))
        x, y = a.x0 + n * a.dx, a.y0 + n * a.dy
        j, i = n[part(x, a.lo_x, a.hi_x) == a.to_i], n[part(y, a.lo_y, a.hi_y) == a.to_j]
        i, j = np.repeat(i, len(j)), np.tile(j, len(i))
        if not len(i):
            return pd.DataFrame(columns=[f.split()[0] for f in rows.split(", ")])
        w, h = (a.hi_x - a.lo_x) / a.k, (a.hi_y - a.lo_y) / a.k
        edge = HALO * (1 - 1e-6)
        box = (a.lo_x + (a.to_i - edge) * w, a.lo_y + (a.to_j - edge) * h, a.lo_x + (a.to_i + 1 + edge) * w, a.lo_y + (a.to_j + 1 + edge) * h)
        xyz = tuple(s[c].to_numpy() for c in ("x", "y", "z", "seq"))
        far = s.rim.to_numpy(bool)
        # A tile without points of its own or around it has those of the hull.
        own = Heights(*(v[~far] if not far.all() else v for v in xyz), box, (a.lo_x, a.lo_y, a.hi_x, a.hi_y))
        outermost = np.flatnonzero(far) if far.any() else np.unique(np.concatenate(hull(xyz[0], xyz[1])))
        f, p = heights(x[j], y[i], own, tuple(v[outermost] for v in xyz))
        return table(s, i, j, x[j], y[i], f, p)

    found = kept(dealt.join(F.broadcast(grids), "site_id").groupBy(*keys, "to_i", "to_j").applyInPandas(look, rows), "nodes")
    done, left = found.where("NOT open").select(*keys, "i", "j", "z"), found.where("open")

    def through(key: tuple, circles: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """The points of a tile that matter for the circles: corners of the triangles that it finds, all on their circles, or nearest ones."""
        if not len(circles) or not len(own):
            return pd.DataFrame(columns=[*keys, "i", "j", "px", "py", "pz", "pseq"])
        a = own.iloc[0]
        mine = Heights(*(own[c].to_numpy() for c in ("x", "y", "z", "seq")), (a.lo_x, a.lo_y, a.hi_x, a.hi_y), (a.lo_x, a.lo_y, a.hi_x, a.hi_y))
        at = {c: circles[c].to_numpy() for c in ("x", "y", "sx", "sy", "mx", "my", "r2", "inside")}
        p = tuple(np.concatenate([v, *[circles[f"{c}{k}"].to_numpy() for k in "abc"]]) for v, c in zip((mine.x, mine.y, mine.z, mine.seq), ("x", "y", "z", "seq"), strict=True))
        n, m = len(mine.x), len(circles)
        parts = mine.within(at["mx"], at["my"], at["r2"])
        corners = n + np.arange(m)[:, None] + m * np.arange(3)
        inner = np.flatnonzero(at["inside"])
        of = lambda part, rows: (np.searchsorted(rows, part[0][k := np.isin(part[0], rows)]), part[1][k], part[2][k])
        _, node, place = best_facets(*(at[c][inner] for c in ("x", "y", "sx", "sy")), p, of(parts, inner), corners[inner])
        outside = np.flatnonzero(~at["inside"])
        best, _ = nearest_of(at["x"][outside], at["y"][outside], p, of(parts, outside))
        node, place = np.concatenate([inner[node], outside[best >= 0]]), np.concatenate([place, best[best >= 0]])
        node, place = node[place < n], place[place < n]
        return pd.DataFrame({"site_id": key[0], "surface": key[1], "i": circles.i.to_numpy()[node], "j": circles.j.to_numpy()[node]} | {f"p{c}": v[place] for c, v in zip(("x", "y", "z", "seq"), p, strict=True)})

    def settle(s: pd.DataFrame) -> pd.DataFrame:
        """The nodes with what tiles found for them; open if a circle became another one."""
        state, more = s[s.x.notna()].sort_values(["i", "j"]), s[s.x.isna()]
        m, number = len(state), lambda t: t.i.to_numpy(np.int64) * grid_n + t.j.to_numpy(np.int64)
        owner = np.searchsorted(number(state), number(more))
        order = np.lexsort((more.pseq.to_numpy(), more.py.to_numpy(), more.px.to_numpy(), owner))
        p = tuple(np.concatenate([more[f"p{c}"].to_numpy()[order], *[state[f"{c}{k}"].to_numpy() for k in "abc"]]) for c in ("x", "y", "z", "seq"))
        p = (*p[:3], p[3].astype(np.int64))
        corners = len(more) + np.arange(m)[:, None] + m * np.arange(3)
        size = np.bincount(owner, minlength=m)
        parts = np.arange(m), np.cumsum(size) - size, size
        qx, qy, sx, sy, inside = (state[c].to_numpy() for c in ("x", "y", "sx", "sy", "inside"))
        inside = inside.astype(bool)
        f, _, _ = best_facets(qx, qy, sx, sy, p, parts, corners)
        moved = f["has"] & (power(qx + sx, qy + sy, f) < power(qx + sx, qy + sy, {c: state[c].to_numpy() for c in ("mx", "my", "r2")}, True))
        both = np.concatenate([np.stack([parts[0], np.arange(m)], axis=1).ravel()[None], np.stack([parts[1], corners[:, 0]], axis=1).ravel()[None], np.stack([size, np.ones(m, np.int64)], axis=1).ravel()[None]])
        # A node without any point so far has its own place for one.
        best, d = nearest_of(qx, qy, p, (both[0], both[1], both[2]))
        f["t"] = np.where(inside[:, None], np.where(f["has"][:, None], f["t"], corners), best[:, None])
        f["z"] = np.where(inside, np.where(f["has"], f["z"], state.z.to_numpy()), p[2][best])
        for c in ("mx", "my", "r2"):
            f[c] = np.where(inside & f["has"], f[c], state[c].to_numpy())
        return table(state, state.i.to_numpy(), state.j.to_numpy(), qx, qy, f | {"open": inside & moved, "inside": inside, "sx": sx, "sy": sy}, p)

    while not left.isEmpty():
        circle = left.join(sides, keys)
        r = F.sqrt("r2") * (1 + 1e-9)
        for v, n in (("x", "ti"), ("y", "tj")):
            circle = circle.withColumn(f"__{v}", F.col(f"m{v}") - r).withColumn(f"__to_{v}", F.col(f"m{v}") + r)
            circle = circle.withColumn(n, F.explode(F.sequence(tile(v, -1e-6, f"__{v}"), tile(v, 1e-6, f"__to_{v}"))))
        # Of the tiles in the circle's box, those that it touches.
        off = lambda v, n: F.greatest(F.lit(0.0), F.col(f"lo_{v}") + (F.col(n) - 1e-6) * (F.col(f"hi_{v}") - F.col(f"lo_{v}")) / F.col("k") - F.col(f"m{v}"), F.col(f"m{v}") - F.col(f"lo_{v}") - (F.col(n) + 1 + 1e-6) * (F.col(f"hi_{v}") - F.col(f"lo_{v}")) / F.col("k"))
        circle = circle.where((off("x", "ti") <= r) & (off("y", "tj") <= r) & (F.hypot(off("x", "ti"), off("y", "tj")) <= r)).select(*left.columns, "ti", "tj")
        got = circle.groupBy(*keys, "ti", "tj").cogroup(large.groupBy(*keys, "ti", "tj")).applyInPandas(through, f"{head}, i int, j int, px double, py double, pz double, pseq long")
        now = kept(left.unionByName(got, allowMissingColumns=True).groupBy(*keys).applyInPandas(settle, rows), "nodes")
        done, left = done.unionByName(now.where("NOT open").select(*keys, "i", "j", "z")), now.where("open")
    return done
