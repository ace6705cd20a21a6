"""Plane geometry as column expressions. y grows downwards; boxes are structs or four columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_bbox(x: Column, y: Column, box: Column) -> Column:
    """Inclusive containment."""
    return x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])


def in_any_bbox(x: Column, y: Column, boxes: Column) -> Column:
    return F.exists(boxes, lambda b: in_bbox(x, y, b))


def bbox_center(box: Column) -> tuple[Column, Column]:
    return (box["x0"] + box["x1"]) / 2.0, (box["y0"] + box["y1"]) / 2.0


def clamp_bbox(box: Column, width: Column, height: Column) -> Column:
    """Whole pixels inside a page of width x height; reversed sides are swapped, and each side is one pixel at least."""

    def side(a: Column, b: Column, size: Column) -> tuple[Column, Column]:
        a, b = (F.greatest(F.lit(0), F.least(v.cast("int"), size)) for v in (a, b))
        lo, hi = F.least(a, b), F.greatest(a, b)
        return lo, F.when(lo == hi, F.least(lo + 1, size)).otherwise(hi)

    x0, x1 = side(box["x0"], box["x1"], width)
    y0, y1 = side(box["y0"], box["y1"], height)
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def rotated_bbox(box: Column, matrix: list[Column], zoom: Column) -> Column:
    """The box around the four corners after x' = a x + c y + e, y' = b x + d y + f (matrix a .. f) and zoom."""
    a, b, c, d, e, f = matrix
    xs = [(a * x + c * y + e) * zoom for x in (box["x0"], box["x1"]) for y in (box["y0"], box["y1"])]
    ys = [(b * x + d * y + f) * zoom for x in (box["x0"], box["x1"]) for y in (box["y0"], box["y1"])]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def axial_angle(dx: Column, dy: Column) -> Column:
    """Direction of a line in degrees, 0 up to 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def axial_difference(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def axis_distance(angle: Column) -> Column:
    """Degrees between a line and the nearer axis."""
    return F.least(axial_difference(angle, F.lit(0.0)), axial_difference(angle, F.lit(90.0)))


def foot_on_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The segment's point nearest to (x, y). A segment shorter than 1e-4.5 is its first end."""
    vx, vy = x2 - x1, y2 - y1
    size = vx * vx + vy * vy
    t = F.when(size < 1e-9, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * vx + (y - y1) * vy) / size)))
    return x1 + t * vx, y1 + t * vy


def turn_angle(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Absolute change of direction between two steps, 0 to pi."""
    return F.abs(F.pmod(F.atan2(dy2, dx2) - F.atan2(dy1, dx1) + F.pi(), 2 * F.pi()) - F.pi())


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a ring of points (array of structs x, y; closed by itself)."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, after, lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"]) + p["x"]), 1).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda n, c: n + c) % 2 == 1


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Signed distance to a ring: positive inside, negative outside."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def away(p: Column, q: Column) -> Column:
        fx, fy = foot_on_segment(x, y, p["x"].cast("double"), p["y"].cast("double"), q["x"].cast("double"), q["y"].cast("double"))
        return F.hypot(x - fx, y - fy)

    d = F.array_min(F.zip_with(ring, after, away))
    return F.when(in_polygon(x, y, ring), d).otherwise(-d)


def stride(n: Column, k: int) -> Column:
    """Step that takes about k of n items."""
    return F.greatest(F.lit(1), F.floor(n / k)).cast("int")


def linspace(a: Column, b: Column, n: Column) -> Column:
    """n evenly spaced values from a to b."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: a + i * (b - a) / F.greatest(n - 1, F.lit(1)))
