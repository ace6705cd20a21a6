"""MinHash near-dedup with odd sketches.

Each document's set of word shingles (64-bit fingerprints) gives k MinHash samples. Bands of `rows` samples bring
likely partners into one bucket. The samples are also folded into an odd sketch, a bitmap in which every sample flips
one bit: the bits in which two sketches differ tell how many samples differ, precisely where similarity is high. Pairs
whose sketches show them far below the threshold are dropped, all others are verified on their full sets, so a link is
never reported on an estimate.

Documents of equal sets are one class with one representative, the smallest id, and only representatives are compared.
Large buckets do not emit all their pairs: at first each member meets only the smallest of its bucket. As buckets of
different bands have different smallest members, near copies of a group are linked by then, and components show it.
What is left is for exactness: a member outside its bucket's main component meets every member of another component. In
small buckets these are pairs like the others. The members of large buckets are dealt to blocks of bounded size by a
hash, and every block of outsiders meets every block of its group, first with the sketches alone, then, where these leave
any pair, with the sets, which are compared at once: only links leave the task, and a group with many members that are
all but similar makes no rows of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracut.llm.components import smallest_reachable
from terracut.llm.scratch import stored
from terracut.llm.words import lower_ascii, mix, split_words, windows

#: A pair of similarity 0.8 misses all 36 bands of 5 samples with a chance of about 6 in 10 million.
BANDS, ROWS = 36, 5
SKETCH_BITS = 512
#: Samples and sketches err by about 0.035 in similarity; pairs this far below the threshold are dropped unseen.
SLACK = 0.2
#: Rounds of one comparison for each member; after them all that may still be linked is compared.
STAR_ROUNDS = 3
#: Members of a bucket that may make pairs of rows; larger buckets are compared in blocks of so many shingles and documents.
DIRECT, BLOCK_SHINGLES, BLOCK_DOCS = 16, 1 << 16, 512


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct fingerprints of each text's k-word shingles; of fewer words, the whole sequence is one."""
    for b in split_words(texts, lower_ascii):
        offs, all_windows = b.offsets, windows(b.codes, k)
        for i in range(len(b.counts)):
            lo, n = offs[i], b.counts[i]
            if n >= k:
                yield np.unique(all_windows[lo : lo + n - k + 1])
            elif n:
                yield windows(b.codes[lo : lo + n], int(n)) ^ np.uint64(n)
            else:
                yield np.zeros(0, np.uint64)


class Sampler:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(77)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.mul = (rng.integers(0, 1 << 32, k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.add = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
        self.salt = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        """The k MinHash samples: under each of k hash functions, the smallest value of the set."""
        low = (shingles >> np.uint64(32)).astype(np.uint32) ^ (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 512):
            x = low[at : at + 512, None] * self.mul[None, :] + self.add[None, :]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(out, x.min(axis=0), out=out)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One bucket key for each band."""
        mixed = mix(samples.astype(np.uint64) + self.salt).reshape(self.bands, self.rows)
        out = np.zeros(self.bands, np.uint64)
        for j in range(self.rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + mixed[:, j])
        return out

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmap: every sample flips the bit that its value and number give."""
        bits = (mix(samples.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) ^ self.salt) % np.uint64(SKETCH_BITS)).astype(np.int64)
        return np.packbits(np.bincount(bits, minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def sketch_similarity(differing: np.ndarray | float, k: int) -> np.ndarray:
    """Similarity that the number of differing bits of two odd sketches of k samples speaks for."""
    share = np.minimum(1 - 2 * np.asarray(differing, float) / SKETCH_BITS, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(share > 0, 1 + SKETCH_BITS / (4 * k) * np.log(np.maximum(share, 1e-300)), -1.0)


def most_differing(threshold: float, k: int) -> int:
    """Bits that sketches may differ in before the pair is dropped."""
    n = np.arange(SKETCH_BITS + 1)
    return int(n[sketch_similarity(n, k) >= threshold - SLACK].max())


def set_name(s: np.ndarray) -> tuple[int, int, int]:
    """n, d1, d2: size and two sums of mixed fingerprints, by which equal sets are known."""
    if not len(s):
        return 0, 0, 0
    one, two = mix(s).sum(), mix(s ^ np.uint64(0x6A09E667F3BCC909)).sum()
    return len(s), int(one.view(np.int64)), int(two.view(np.int64))


def describe(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """id, text_hash, n, d1, d2 (the set's name), keys (of the bands) and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands, rows)
        for batch in batches:
            names, keys, sketches = [], [], []
            for s in shingle_sets(batch.column(1), k):
                names.append(set_name(s))
                if len(s):
                    drawn = sampler.samples(s)
                    keys.append(sampler.keys(drawn))
                    sketches.append(sampler.sketch(drawn))
                else:
                    keys.append(np.zeros(0, np.uint64))
                    sketches.append(np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]) if keys else np.zeros(1)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            columns = [pa.array(c, pa.int64()) for c in zip(*names, strict=True)] if names else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64))), pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "text_hash", "n", "d1", "d2", "keys", "sketch"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    return narrow.mapInArrow(run, "id long, text_hash long, n long, d1 long, d2 long, keys array<long>, sketch array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets s have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xo, yo = np.asarray(x.offsets), np.asarray(y.offsets)
            xv, yv = np.asarray(x.values), np.asarray(y.values)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                s, t = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                both = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
                good[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def common_counts(x_at: np.ndarray, x: np.ndarray, y_at: np.ndarray, y: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Intersection sizes of all sets of one block with all of another. x: the sets end to end, x_at: where they begin and end."""
    both = np.intersect1d(x, y)
    out = np.zeros((len(x_at) - 1, len(y_at) - 1), np.float32)

    def cells(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(both, values), len(both) - 1)
        there = np.flatnonzero(both[place] == values)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[there]
        order = np.argsort(place[there], kind="stable")
        return owner[order], place[there][order]

    if len(both):
        (xo, xc), (yo, yc) = cells(x_at, x), cells(y_at, y)
        for lo in range(0, len(both), chunk):
            width = min(chunk, len(both) - lo)
            sides = []
            for owner, column, n in ((xo, xc, len(x_at) - 1), (yo, yc, len(y_at) - 1)):
                a, b = np.searchsorted(column, [lo, lo + width])
                table = np.zeros((n, width), np.float32)
                table[owner[a:b], column[a:b] - lo] = 1
                sides.append(table)
            out += sides[0] @ sides[1].T
    return out


def parts_of(members: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """id, component, sketch and set size of a block's members."""
    return np.asarray(members.field("id")), np.asarray(members.field("c")), np.asarray(members.field("sketch").flatten()).view(np.uint64).reshape(len(members), -1), np.asarray(members.field("n"))


def likely_pairs(x: pa.Array, y: pa.Array, percent: int, bound: int) -> np.ndarray:
    """Which members of two blocks may be linked: of different components, alike in size, and with sketches that differ in bound bits at most."""
    (_, xc, xk, xn), (_, yc, yk, yn) = parts_of(x), parts_of(y)
    differing = np.zeros((len(x), len(y)), np.int64)
    for word in range(xk.shape[1]):
        differing += np.bitwise_count(xk[:, word, None] ^ yk[None, :, word])
    return (differing <= bound) & (xc[:, None] != yc[None, :]) & (100 * np.minimum(xn[:, None], yn[None, :]) >= percent * np.maximum(xn[:, None], yn[None, :]))


def block_links(inside: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, bound: int) -> DataFrame:
    """Links (a, b) of the outsiders of each group with all of its members of other components. inside: g, id, c; outsiders: c is not g.

    Members are dealt to blocks of bounded size. Blocks meet with their sketches at first, a few dozen bytes for each
    member; only blocks that have pairs whose sketches differ in bound bits at most meet again with their full sets.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [likely_pairs(batch.column(3).slice(i, 1).flatten(), batch.column(4).slice(i, 1).flatten(), percent, bound).any() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near, pa.bool_())) for k in range(3)], names=["g", "block", "other"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (batch.column(k).slice(row, 1).flatten() for k in (0, 1))
                likely = likely_pairs(x, y, percent, bound)
                left, right = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
                (xi, _, _, xn), (yi, _, _, yn) = parts_of(x), parts_of(y)
                both = common_counts(*lists(x, left), *lists(y, right))
                near = 100 * both >= percent * (xn[left][:, None] + yn[right][None, :] - both)
                i, j = np.nonzero(near & likely[np.ix_(left, right)])
                a, b = xi[left[i]], yi[right[j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def lists(members: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets of some members end to end: where they begin and end, and their values."""
        s = members.field("s").take(pa.array(rows))
        return np.concatenate([[0], np.cumsum(np.asarray(s.value_lengths()).astype(np.int64))]), np.asarray(s.flatten())

    members = inside.join(sketches, "id")
    need = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS))
    number = members.groupBy("g").agg(need.alias("blocks"))
    dealt = stored(members.join(number, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "block-members")

    def blocks(of: DataFrame, columns: list[str], name: str) -> DataFrame:
        # Dealt by block, or a group's blocks would all meet in the task of its join.
        return of.repartition("g", "block").groupBy("g", "block", "blocks").agg(F.collect_list(F.struct(*columns)).alias(name))

    light = ["id", "c", "sketch", "n"]
    outer = blocks(dealt.where("c != g"), light, "x").select("g", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "x")
    met = outer.join(blocks(dealt, light, "y").select("g", F.col("block").alias("other"), "y"), ["g", "other"])
    wanted = stored(met.select("g", "block", "other", "x", "y").mapInArrow(meet, "g long, block long, other long"), "block-pairs")
    own = lambda side: wanted.select("g", F.col(side).alias("block")).distinct()
    full = [*light, "s"]
    xs = blocks(dealt.where("c != g").join(own("block"), ["g", "block"], "left_semi").join(sets, "id"), full, "x").select("g", "block", "x")
    ys = blocks(dealt.join(own("other"), ["g", "block"], "left_semi").join(sets, "id"), full, "y").select("g", F.col("block").alias("other"), "y")
    return wanted.join(xs, ["g", "block"]).join(ys, ["g", "other"]).select("x", "y").mapInArrow(compare, "a long, b long").distinct()


def linked_classes(members: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, k: int) -> DataFrame | None:
    """node, component of the representatives that have links: all that true links among bucket mates connect. None without links.

    members: bucket, id of buckets with at least two. sets_of(ids): id, s (full sets) of some representatives.
    """
    bound = most_differing(percent / 100, k)
    tries: DataFrame | None = None
    links: DataFrame | None = None
    labels: DataFrame | None = None
    sets = stored(sets_of(members.select("id").distinct()), "shingle-sets")
    n_members = members.count()
    for turn in range(STAR_ROUNDS + 1):
        if labels is None:
            here = members.withColumn("c", F.col("id"))
            stars = members.groupBy("bucket").agg(F.min("id").alias("lead"))
        else:
            here = members.join(labels, members["id"] == labels["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
            # The main component of a bucket, and one of its members, another one in each round.
            sizes = here.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("m"), F.min_by("id", F.xxhash64(F.lit(turn), "id")).alias("lead"))
            stars = sizes.groupBy("bucket").agg(F.max(F.struct("m", -F.col("c"))).alias("top"), F.max_by("lead", F.struct("m", -F.col("c"))).alias("lead"), F.sum("m").alias("all")).where("top.m < all")
            stars = stars.select("bucket", "lead", (-F.col("top.col2")).alias("main"), (F.col("all") - F.col("top.m")).alias("out"), "all")
        if turn:
            stars = stored(stars, "stars")
            row = stars.agg(F.coalesce(F.sum(F.col("out") * F.col("all")), F.lit(0)).alias("cost")).first()
            if not row.cost:
                break
            rest = here.join(stars, "bucket")
            if row.cost <= 4 * n_members or turn == STAR_ROUNDS or unlinked:
                # Exact end: all that stand outside their bucket's main component against all of other components. Without
                # links, further stars would have the same leads.
                outer = rest.where((F.col("c") != F.col("main")) & (F.col("all") <= DIRECT)).select("bucket", F.col("id").alias("x"), F.col("c").alias("cx"))
                pairs = outer.join(here, "bucket").where(F.col("cx") != F.col("c")).select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))
                last = True
            else:
                pairs = rest.where(F.col("c") != F.col("main")).select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
                last = False
        else:
            pairs = here.join(stars, "bucket").where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
            last = False
        pairs = pairs.distinct()
        if tries is not None:
            pairs = pairs.join(tries, ["a", "b"], "left_anti")
        # Odd sketches first: the bits in which they differ.
        sa, sb = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("ka"), F.col("n").alias("na")), sketches.select(F.col("id").alias("b"), F.col("sketch").alias("kb"), F.col("n").alias("nb"))
        differing = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        likely = stored(pairs.join(sa, "a").join(sb, "b").where(sized & (differing <= bound)).select("a", "b"), "likely-pairs")
        tries = likely if tries is None else tries.unionAll(likely)
        found = verified(likely, sets, percent)
        if last:
            found = found.unionAll(block_links(rest.where(F.col("all") > DIRECT).select(F.col("main").alias("g"), "id", "c").distinct(), sketches, sets, percent, bound))
        found = stored(found, "links")
        links = found if links is None else links.unionAll(found)
        unlinked = links.isEmpty()
        labels = stored(smallest_reachable(links), "labels") if not unlinked else None
        if last:
            break
        if unlinked:
            labels = members.sparkSession.createDataFrame([], "node long, component long")
    return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept (id is component_id),
    text_hash (xxhash64 of the text, null like the empty text).

    Words are separated by ASCII white space; A-Z count as a-z. Documents are linked when 100 * intersection of their
    shingle sets is at least percent * union. Null and word-less texts have the empty set, are linked with nothing, and
    are kept. With fewer than k words, the whole sequence is the one shingle. A null id takes part, but never stands for
    others: where only null ids have a set, their component_id is null and they are kept. Repeated rows (same id, same
    text) share one decision. Where rows of one id have different texts, each text is linked for itself. Very long texts
    count whole. An empty table gives an empty table. Only id_col (an integer) and text_col are read, so other columns
    cannot clash.
    """
    described = stored(describe(docs, id_col, text_col, k, bands, rows), "minhash")
    # Classes of equal sets. Sizes and two sums of mixed fingerprints name a set.
    same = ["n", "d1", "d2"]
    classes = described.where("n > 0 AND id IS NOT NULL").groupBy(*same).agg(F.min("id").alias("rep"), F.min_by(F.struct("keys", "sketch"), "id").alias("own"))
    classes = stored(classes.select(*same, "rep", "own.keys", "own.sketch"), "classes")
    # A class goes by its smallest id. An id that is the smallest of several classes, having several texts, names none
    # of them: these go by a hash.
    repeated = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("rep", F.lit(True).alias("again"))
    if repeated.isEmpty():
        classes = classes.withColumn("node", F.col("rep"))
    else:
        classes = stored(classes.join(repeated, "rep", "left").withColumn("node", F.when(F.col("again"), F.xxhash64("rep", *same)).otherwise(F.col("rep"))).drop("again"), "named-classes")
    members = classes.select("node", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), F.col("node").alias("id"))
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    members = stored(members.join(crowded, "bucket", "left_semi"), "buckets")

    def sets_of(ids: DataFrame) -> DataFrame:
        """node, s of the classes whose node is in ids, each read from one text of its id that has the class's set."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets, true = [], np.zeros(batch.num_rows, bool)
                wanted = [np.asarray(batch.column(c)) for c in same]
                for i, s in enumerate(shingle_sets(batch.column(1), k)):
                    if set_name(s) == tuple(int(w[i]) for w in wanted):
                        true[i] = True
                        sets.append(np.sort(s.view(np.int64)))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]) if sets else np.zeros(1)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(true)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["id", "s"])

        wanted = classes.join(ids, classes["node"] == ids["id"], "left_semi").select("rep", "node", *same)
        texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("t")).where("t IS NOT NULL").join(wanted, "rep")
        # Repeated rows are settled here, where all rows of an id are together.
        texts = texts.dropDuplicates(["rep", "node", "t"]).select("node", "t", *same)
        return texts.mapInArrow(run, "id long, s array<long>")

    sketches = classes.select(F.col("node").alias("id"), "sketch", "n")
    labels = linked_classes(members, sketches, sets_of, percent, bands * rows)
    named = classes.select(*same, "rep", "node")
    if labels is not None:
        labels = labels.withColumnRenamed("node", "linked")
        least = named.join(labels, named["node"] == labels["linked"]).select("component", "linked", "rep")
        least = least.join(least.groupBy("component").agg(F.min("rep").alias("least")), "component").select("linked", "least")
        named = named.join(least, named["node"] == least["linked"], "left").select(*same, F.coalesce("least", "rep").alias("component"))
    else:
        named = named.select(*same, F.col("rep").alias("component"))
    out = described.select("id", "text_hash", *same).join(named, same, "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_hash")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that near_dedup() keeps, with all their columns, whatever their names. Rows are judged by id and text."""
    kept = near_dedup(docs, id_col, text_col, k, percent).where("kept").select(F.col(id_col).alias("kept_id"), "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("text_hash")), "left_semi").select("row.*")
