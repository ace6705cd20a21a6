"""Lines through the pixels of a skeleton, all pages at once.

Pixels are joined to their neighbours (a diagonal only where no pixel beside it makes the same way). Where edges meet, two
of them are one line if each is the other's straightest continuation; straightest first, ties by direction. Every edge
thus has one edge before it at most, and lines are lists. Places along a list come from pointer doubling: each round
joins every edge to the one that its pointer names, so rounds grow with the logarithm of the longest line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracut.sources.scratch import kept, many

# The eight directions, clockwise from the right (y grows downwards).
DX, DY = (1, 1, 0, -1, -1, -1, 0, 1), (0, 1, 1, 1, 0, -1, -1, -1)
#: Bits of a pixel's column in its number.
COLUMN_BITS = 24


def pick(values: tuple[int, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def pixel_number(x: Column, y: Column) -> Column:
    """Numbers of pixels in reading order."""
    return F.shiftleft(y.cast("long"), COLUMN_BITS) + x


def arcs_of(pixels: DataFrame) -> DataFrame:
    """sheet_id, arc, before (null at the end of a line): every edge in both directions, as 8 * number of its pixel + direction.

    pixels: sheet_id, x, y, each once.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(DX[d]).alias("dx"), F.lit(DY[d]).alias("dy")) for d in range(8)]))
    offers = pixels.select("sheet_id", (F.col("x") + 0).alias("ox"), (F.col("y") + 0).alias("oy"), steps.alias("s"))
    # A pixel offers itself to the eight around it, each of which sees it in the opposite direction.
    offers = offers.select("sheet_id", (F.col("ox") + F.col("s.dx")).alias("x"), (F.col("oy") + F.col("s.dy")).alias("y"), ((F.col("s.d") + 4) % 8).alias("d"))
    near = pixels.join(many(offers), ["sheet_id", "x", "y"]).groupBy("sheet_id", "x", "y").agg(F.sort_array(F.collect_list("d")).alias("seen"))
    beside = lambda d: (d % 2 == 1) & (F.array_contains("seen", (d + 7) % 8) | F.array_contains("seen", (d + 1) % 8))
    near = near.select("sheet_id", pixel_number(F.col("x"), F.col("y")).alias("pixel"), F.filter("seen", lambda d: ~beside(d)).alias("out"))
    # Two edges make the straighter a line the farther their directions are apart.
    apart = lambda a, b: F.least(F.pmod(a - b, F.lit(8)), F.pmod(b - a, F.lit(8)))
    pairs = F.flatten(F.transform("out", lambda a: F.transform(F.filter("out", lambda b: b > a), lambda b: F.struct((-apart(a, b)).alias("turn"), a.alias("a"), b.alias("b")))))
    near = near.withColumn("pairs", pairs)
    best = lambda d: F.array_min(F.filter("pairs", lambda p: (p["a"] == d) | (p["b"] == d)))
    partner = lambda d: F.when(best(d)["a"] == d, best(d)["b"]).otherwise(best(d)["a"])
    links = F.transform("out", lambda d: F.struct(d.alias("d"), F.when(best(d) == best(partner(d)), partner(d)).alias("with")))
    arcs = near.select("sheet_id", "pixel", F.explode(links).alias("l"))
    step = F.shiftleft(pick(DY, F.col("l.with")).cast("long"), COLUMN_BITS) + pick(DX, F.col("l.with"))
    before = F.when(F.col("l.with").isNotNull(), (F.col("pixel") + step) * 8 + (F.col("l.with") + 4) % 8)
    return arcs.select("sheet_id", (F.col("pixel") * 8 + F.col("l.d")).alias("arc"), before.alias("before"))


def ranked(arcs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """sheet_id, arc, head (first arc of its list), pos; and the arcs of rings, which have no first, with the least of each.

    In every round some arc of each list reaches its head, if any is left that has not; so when none does, rings are left.
    """
    at = kept(arcs.select("sheet_id", "arc", F.coalesce("before", "arc").alias("head"), F.col("before").isNotNull().cast("long").alias("pos"), F.col("before").isNull().alias("done"), F.least("arc", F.coalesce("before", "arc")).alias("least")), "ranks")
    waiting, done = None, None
    while True:
        n, rest = at.where("NOT done").count(), at.where("NOT done")
        if not n:
            return at.select("sheet_id", "arc", "head", "pos") if done is None else done, None
        if n == waiting:
            break
        waiting = n
        other = at.select("sheet_id", F.col("arc").alias("head"), F.col("head").alias("next"), F.col("pos").alias("more"), F.col("done").alias("there"), F.col("least").alias("lower"))
        moved = rest.join(many(other), ["sheet_id", "head"]).select("sheet_id", "arc", F.col("next").alias("head"), (F.col("pos") + F.col("more")).alias("pos"), F.col("there").alias("done"), F.least("least", "lower").alias("least"))
        at = kept(moved.unionByName(at.where("done")), "ranks")
    lists = at.where("done").select("sheet_id", "arc", "head", "pos")
    rings = kept(at.where("NOT done").select("sheet_id", "arc", "head", "least"), "rings")
    while True:  # the least of a ring goes around it
        other = rings.select("sheet_id", F.col("arc").alias("head"), F.col("head").alias("next"), F.col("least").alias("lower"))
        spread = kept(rings.join(many(other), ["sheet_id", "head"]).select("sheet_id", "arc", F.col("next").alias("head"), F.least("least", "lower").alias("least"), (F.col("lower") < F.col("least")).alias("fell")), "rings")
        rings = spread.drop("fell")
        if spread.where("fell").isEmpty():
            break
    return lists, rings.select("sheet_id", "arc", "least")


def traced(pixels: DataFrame) -> DataFrame:
    """sheet_id, path, pos, x, y: the lines through the pixels (sheet_id, x, y), each in one direction.

    A line starts at the end whose first edge has the lower number; a ring at its least edge, and its last point is its
    first again. path is the number of the first edge. Pixels without neighbours make no line.
    """
    arcs = kept(arcs_of(pixels), "arcs")
    lists, rings = ranked(arcs)
    if rings is not None:
        cut = arcs.join(many(rings), ["sheet_id", "arc"]).select("sheet_id", "arc", F.when(F.col("arc") != F.col("least"), F.col("before")).alias("before"))
        lists = lists.unionByName(ranked(cut)[0])
    lists = kept(lists, "lists")
    pixel, d = F.shiftright("arc", 3), F.col("arc") % 8
    ahead = pixel + F.shiftleft(pick(DY, d).cast("long"), COLUMN_BITS) + pick(DX, d)
    # Of a line's two directions, the one whose first arc is lower: the list that has the first arc's reverse is the other.
    back = lists.where("pos = 0").select("sheet_id", "head", (ahead * 8 + (d + 4) % 8).alias("arc"))
    other = back.join(many(lists.select("sheet_id", "arc", F.col("head").alias("opposite"))), ["sheet_id", "arc"]).where("head < opposite").select("sheet_id", "head")
    one = lists.join(many(other), ["sheet_id", "head"], "left_semi")
    points = one.select("sheet_id", F.col("head").alias("path"), F.explode(F.when(F.col("pos") == 0, F.array(F.struct(F.lit(0).cast("long").alias("pos"), pixel.alias("at")), F.struct(F.lit(1).cast("long").alias("pos"), ahead.alias("at")))).otherwise(F.array(F.struct((F.col("pos") + 1).alias("pos"), ahead.alias("at"))))).alias("p"))
    return points.select("sheet_id", "path", "p.pos", (F.col("p.at") % (1 << COLUMN_BITS)).cast("int").alias("x"), F.shiftright("p.at", COLUMN_BITS).cast("int").alias("y"))


def line_lengths(points: DataFrame) -> DataFrame:
    """sheet_id, path, length: that of each traced line, from its numbers of straight and diagonal steps."""
    both = points.select("sheet_id", "path", "pos", "x", "y")
    after = both.select("sheet_id", "path", (F.col("pos") - 1).alias("pos"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    diagonal = (F.col("x") != F.col("nx")) & (F.col("y") != F.col("ny"))
    steps = both.join(many(after), ["sheet_id", "path", "pos"])
    return steps.groupBy("sheet_id", "path").agg((F.count_if(~diagonal) + F.count_if(diagonal) * F.sqrt(F.lit(2.0))).alias("length"))


def pixels_of(runs: DataFrame) -> DataFrame:
    """sheet_id, x, y of the pixels of runs."""
    return runs.select("sheet_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y")
