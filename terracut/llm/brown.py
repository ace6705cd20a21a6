"""LM scoring with Brown class-based n-grams.

P(text) is the product over tokens of P(class | class before) * P(word | class). Every training word has a class of its
own, found in two steps:

1. Exchange among units: words of at least UNIT_SHARE of all training tokens are units of their own, all rarer words with
   one ending (their last three bytes) form a unit together. Spark counts how often each unit follows and precedes each
   class; with these counts, unit after unit moves to the class that raises the class bigram likelihood most; then Spark
   counts anew. This table is bounded (1 / UNIT_SHARE words and ENDINGS endings), as its sweep runs on the driver.
2. Every rarer word, however many there are, leaves its ending's unit: Spark counts which classes stand before and after
   the word, and the word takes the class that these counts raise the likelihood most in. This table grows with the
   corpus, is spread by word, and is never collected.

Transitions are then counted from the training texts under the final classes. A word never seen has its ending's class;
within a class, words have their share of the training tokens, and the endings' unseen words have what words seen once
stand for. So the probabilities of all known words of a class and of its endings' unseen words add up to one.

Words of at least LOCAL_SHARE of all tokens (at most 1 / LOCAL_SHARE, 17 bytes each) go to the tasks; rarer ones, none of
them a hot key, are looked up by a join and put in the gaps that texts, turned into one byte a token, have left for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracut.llm.scratch import stored
from terracut.llm.words import Words, lower_ascii, mix, split_words

UNIT_SHARE, LOCAL_SHARE = 5e-5, 5e-7
#: ROUNDS is the most sweeps of exchange; it ends sooner when no unit moves.
ENDINGS, CLASSES, ROUNDS = 2048, 64, 6
#: Bits of a word's code that give way to the class and side of a neighbour, and the class of a word yet to be looked up.
CELL_BITS, GAP = 7, 255


class Tally:
    """Counts of 64-bit keys, compacted now and then: memory follows the number of distinct keys."""

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.keys, self.counts, self.held = limit, [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * self.limit:
            self.compact()

    def compact(self) -> None:
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def batches(self, names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        """Everything counted so far; then it is empty."""
        if self.keys:
            self.compact()
            keys, counts = self.keys[0].view(np.int64), self.counts[0]
            for at in range(0, len(keys), rows):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + rows]), pa.array(counts[at : at + rows])], names=names)
        self.keys, self.counts, self.held = [], [], 0


def tallies(texts: DataFrame, keys_of, names: list[str]) -> DataFrame:
    """Counts of the keys that keys_of(block of words) gives, for each task (and again where a task has very many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for block in split_words(batch.column(0), lower_ascii):
                tally.add(keys_of(block))
            if tally.held > tally.limit:
                yield from tally.batches(names)
        yield from tally.batches(names)

    return texts.mapInArrow(run, f"{names[0]} long, {names[1]} long")


def tallied(texts: DataFrame, keys_of, names: list[str]) -> DataFrame:
    """Counts of the keys that keys_of(block of words) gives, over all rows of texts (one text column)."""
    return tallies(texts, keys_of, names).groupBy(names[0]).agg(F.sum(names[1]).alias(names[1]))


def coded(block: Words) -> np.ndarray:
    """A code for each word: its fingerprint, with a number for its last three bytes in the lowest bits."""
    at, key = block.ends, np.zeros(len(block.ends), np.uint64)
    for j in (3, 2, 1):
        inside = at - j >= block.starts
        key = key * np.uint64(257) + np.where(inside, lower_ascii(block.data[np.maximum(at - j, 0)]).astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (block.codes & ~np.uint64(ENDINGS - 1)) | (mix(key) & np.uint64(ENDINGS - 1))


def ending_of(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint64(ENDINGS - 1)).astype(np.int64)


@dataclass
class Units:
    words: np.ndarray  # sorted codes of the words that are units of their own

    @property
    def end(self) -> int:
        return len(self.words) + ENDINGS

    @property
    def total(self) -> int:
        return self.end + 1

    def of(self, codes: np.ndarray) -> np.ndarray:
        rest = len(self.words) + ending_of(codes)
        if not len(self.words):
            return rest
        at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        return np.where(self.words[at] == codes, at, rest)

    def sequence(self, block: Words, units: np.ndarray) -> np.ndarray:
        """The units of all texts in a row, an end before, between and after them."""
        return np.insert(units, block.offsets, self.end)


@dataclass
class Model:
    units: Units
    classes: np.ndarray  # class of each unit
    local_words: np.ndarray  # sorted codes of the words that go to the tasks, with their counts and classes
    local_counts: np.ndarray
    local_classes: np.ndarray
    tokens: int
    types: int
    texts: int
    mass: np.ndarray  # of each class: training tokens, and what unseen words may be
    unseen: np.ndarray  # of each ending: how many tokens unseen words stand for
    transition: np.ndarray | None = None  # log10 P(class | class before)

    def ending_class(self, codes: np.ndarray) -> np.ndarray:
        return self.classes[len(self.units.words) + ending_of(codes)]

    @property
    def end_class(self) -> int:
        return int(self.classes[self.units.end])

    def emission(self, codes: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 P(word | its class); a count of 0 stands for any unseen word of the ending."""
        return np.log10(np.where(counts > 0, counts, self.unseen[ending_of(codes)]) / self.mass[classes])

    def end_emission(self) -> float:
        return float(np.log10((self.texts + 0.1) / self.mass[self.end_class]))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def better_classes(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """One sweep of exchange: left and right are units x classes counts of what stands before and after."""
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    classes = classes.copy()
    follows = np.zeros((n_classes, n_classes))
    np.add.at(follows, classes, right)
    mass = np.bincount(classes, weights=sizes, minlength=n_classes)
    for u in np.argsort(-sizes, kind="stable"):
        if not sizes[u]:
            break
        a, l, r, n = classes[u], left[u], right[u], sizes[u]
        follows[:, a] = np.maximum(follows[:, a] - l, 0)
        follows[a] = np.maximum(follows[a] - r, 0)
        mass[a] = max(mass[a] - n, 0)
        gain = (f(follows + l[:, None]) - f(follows)).sum(axis=0) + (f(follows + r[None, :]) - f(follows)).sum(axis=1) - 2 * (f(mass + n) - f(mass))
        b = int(np.argmax(gain))
        classes[u] = b
        follows[:, b] += l
        follows[b] += r
        mass[b] += n
    return classes


def neighbours(bigrams: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """units x classes counts of the classes before and after each unit."""
    total = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(2 * total * n_classes)
        for batch in batches:
            pair, n = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(float)
            u, v = pair // total, pair % total
            tally += np.bincount(v * n_classes + classes[u], weights=n, minlength=len(tally))
            tally += np.bincount((total + u) * n_classes + classes[v], weights=n, minlength=len(tally))
        cells = np.flatnonzero(tally)
        for at in range(0, len(cells), 100_000):
            c = cells[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(tally[c].astype(np.int64))], names=["cell", "n"])

    got = bigrams.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(2 * total * n_classes)
    table[np.asarray(got["cell"])] = np.asarray(got["n"])
    table = table.reshape(2, total, n_classes)
    return table[0], table[1]


def own_classes(texts: DataFrame, units: Units, classes: np.ndarray, follows: np.ndarray, mass: np.ndarray) -> DataFrame:
    """word (a code without its last bits), own: the class of every training word that is no unit of its own.

    The change of likelihood of moving a word with n tokens to class c, to the first order, is
    sum of log N(k, c) over classes k before it + sum of log N(c, k) over classes k behind it - 2 n log N(c).
    """
    n_classes = len(mass)
    shipped = texts.sparkSession.sparkContext.broadcast((units, classes))

    def contexts(block: Words) -> np.ndarray:
        units, classes = shipped.value
        codes = coded(block)
        own = units.of(codes)
        around = classes[units.sequence(block, own)].astype(np.uint64)
        at = np.flatnonzero(own >= len(units.words))
        place = at + block.owners[at] + 1  # in the sequence, where every text has an end before it
        word = codes[at] >> np.uint64(CELL_BITS) << np.uint64(CELL_BITS)
        return np.concatenate([word | around[place - 1], word | around[place + 1] | np.uint64(64)])

    fits = np.concatenate([np.log(follows + 0.5), np.log(follows + 0.5).T]) - np.log(mass + 1)[None, :]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            table = np.zeros((batch.num_rows, 128))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            table[row, np.asarray(lists.flatten().field("k"))] = np.asarray(lists.flatten().field("n"))
            used = np.concatenate([table[:, :n_classes], table[:, 64 : 64 + n_classes]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(np.argmax(used @ fits, axis=1).astype(np.int32))], names=["word", "own"])

    # Tasks have counted already: their counts meet once, by word, and a word has at most 128 of them then.
    cells = tallies(texts, contexts, ["cell", "n"]).select(F.shiftright("cell", CELL_BITS).alias("word"), F.col("cell").bitwiseAND(F.lit(127)).cast("int").alias("k"), "n")
    grouped = cells.repartition("word").groupBy("word", "k").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("k", "n")).alias("cells"))
    return grouped.mapInArrow(choose, "word long, own int")


def train(texts: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of the one text column of texts, without its transitions, and the table of words (code, n, own: the class; null for units)."""
    if not 1 <= n_classes <= 64:
        raise ValueError("there must be 1 to 64 classes")
    counts = stored(tallied(texts, coded, ["code", "n"]), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types")).first()
    n_texts = texts.count()
    tokens, types = sums.tokens + n_texts, sums.types + (n_texts > 0)
    # At most 1 / UNIT_SHARE rows.
    units = Units(np.sort(np.asarray(counts.where(F.col("n") >= tokens * UNIT_SHARE).select("code").toArrow()["code"]).view(np.uint64)))
    total = units.total
    shipped = texts.sparkSession.sparkContext.broadcast(units)

    def pairs(block: Words) -> np.ndarray:
        s = shipped.value.sequence(block, shipped.value.of(coded(block)))
        return (s[:-1] * total + s[1:]).astype(np.uint64)

    bigrams = stored(tallied(texts, pairs, ["pair", "n"]), "unit-bigrams")
    classes = np.arange(total) % n_classes
    left, right = neighbours(bigrams, classes, n_classes)
    for _ in range(rounds):
        moved = better_classes(left, right, right.sum(axis=1), classes, n_classes)
        if (moved == classes).all():
            break
        classes = moved
        left, right = neighbours(bigrams, classes, n_classes)
    follows = np.zeros((n_classes, n_classes))
    np.add.at(follows, classes, right)
    sizes = right.sum(axis=1)
    own = own_classes(texts, units, classes, follows, np.bincount(classes, weights=sizes, minlength=n_classes))
    words = stored(counts.join(own, F.shiftright(counts["code"], CELL_BITS) == own["word"], "left").select("code", "n", "own"), "word-classes")
    # What the tasks need of the words: at most 1 / LOCAL_SHARE rows, and one for each class and ending.
    local = words.where(F.col("n") >= tokens * LOCAL_SHARE).toArrow()
    codes, n = np.asarray(local["code"]).view(np.uint64), np.asarray(local["n"])
    chosen = np.asarray(local["own"].fill_null(-1))
    order = np.argsort(codes)
    codes, n, chosen = codes[order], n[order], chosen[order]
    unit = units.of(codes)
    chosen = np.where((unit < len(units.words)) | (chosen < 0), classes[unit], chosen)
    rare = F.col("n") < tokens * UNIT_SHARE
    once = words.where((F.col("n") == 1) & rare).groupBy(F.col("code").bitwiseAND(F.lit(ENDINGS - 1)).alias("ending")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    # Unseen words stand for as many tokens as words seen once; a tenth more is spread over all endings.
    unseen = np.full(ENDINGS, (sum(once["n"].to_pylist()) + 1) / (10 * ENDINGS))
    unseen[np.asarray(once["ending"])] += np.asarray(once["n"])
    held = words.where(rare).groupBy("own").agg(F.sum("n").alias("n")).toArrow()
    mass = np.bincount(classes[: len(units.words)], weights=sizes[: len(units.words)], minlength=n_classes).astype(float)
    mass[np.asarray(held["own"])] += np.asarray(held["n"])
    mass += np.bincount(classes[len(units.words) : units.end], weights=unseen, minlength=n_classes)
    mass[classes[units.end]] += n_texts + 0.1
    return Model(units, classes, codes, n, chosen.astype(np.uint8), tokens, types, n_texts, mass, unseen), words


def class_sequences(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """One row per row of docs (who, learnt, t): who, learnt, n_tokens, n_known, base, inner (the sum of log10 P(word | class)) and
    classes: one byte for each token, the end included.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        log_base, log_inner = m.base(m.local_counts), m.emission(m.local_words, m.local_counts, m.local_classes)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in split_words(batch.column(2), lower_ascii):
                n, codes, owner = len(b.counts), coded(b), b.owners
                at = np.minimum(np.searchsorted(m.local_words, codes), max(len(m.local_words) - 1, 0))
                here = m.local_words[at] == codes if len(m.local_words) else np.zeros(len(codes), bool)
                seen = at[here]
                classes = np.full(len(codes), GAP, np.uint8)
                classes[here] = m.local_classes[seen]
                whole = np.insert(classes, b.offsets[1:], m.end_class)
                far, begin = np.flatnonzero(~here), np.concatenate([[0], np.cumsum(b.counts + 1)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(b.first, n), batch.column(1).slice(b.first, n), pa.array(key + np.arange(n)), pa.array(b.counts + 1),
                        pa.array(np.bincount(owner[here], minlength=n) + (m.texts > 0)),
                        pa.array(np.bincount(owner[here], weights=log_base[seen], minlength=n) + m.base(np.array(m.texts))),
                        pa.array(np.bincount(owner[here], weights=log_inner[seen], minlength=n) + m.end_emission()),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(whole.tobytes())]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[far], minlength=n))]), pa.int32()), pa.array(codes[far].view(np.int64))),
                    ],
                    names=["who", "learnt", "row", "n_tokens", "n_known", "base", "inner", "classes", "far"],
                )
                key += n

    who = docs.schema["who"].dataType.simpleString()
    columns = f"who {who}, learnt boolean, row long, n_tokens long, n_known long, base double, inner double, classes binary, far array<long>"
    texts = stored(docs.select("who", "learnt", "t").mapInArrow(near, columns), "lm-near")
    # The rarer words of each text, once each, with what the corpus knows of them.
    wanted = texts.select("row", F.explode(F.array_distinct("far")).alias("code"))
    found = wanted.join(words.where(F.col("n") < model.tokens * LOCAL_SHARE), "code").groupBy("row").agg(F.collect_list(F.struct("code", "n", "own")).alias("found"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            far, found = batch.column("far"), batch.column("found")
            codes = np.asarray(far.flatten()).view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(far.value_lengths()).astype(np.int64))
            held = found.flatten()
            key = np.asarray(held.field("code")).view(np.uint64)
            distinct, first = np.unique(key, return_index=True)
            counts, classes = np.zeros(len(codes), np.int64), m.ending_class(codes)
            if len(distinct):
                at = np.minimum(np.searchsorted(distinct, codes), len(distinct) - 1)
                known = distinct[at] == codes
                counts[known] = np.asarray(held.field("n"))[first][at[known]]
                own = np.asarray(held.field("own").fill_null(-1))[first][at[known]]
                classes[known] = np.where(own >= 0, own, classes[known])
            whole = batch.column("classes").cast(pa.large_binary())
            offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
            flat = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy() if len(whole) else np.zeros(0, np.uint8)
            flat[flat == GAP] = classes
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("who"), batch.column("learnt"), batch.column("n_tokens"),
                    pa.array(np.asarray(batch.column("n_known")) + np.bincount(owner[counts > 0], minlength=n)),
                    pa.array(np.asarray(batch.column("base")) + np.bincount(owner, weights=m.base(counts), minlength=n)),
                    pa.array(np.asarray(batch.column("inner")) + np.bincount(owner, weights=m.emission(codes, counts, classes), minlength=n)),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets - offsets[0] if n else np.zeros(1, np.int64)), pa.py_buffer(flat.tobytes())]).cast(pa.binary()),
                ],
                names=["who", "learnt", "n_tokens", "n_known", "base", "inner", "classes"],
            )

    return texts.join(found, "row", "left").mapInArrow(fill, f"who {who}, learnt boolean, n_tokens long, n_known long, base double, inner double, classes binary")


def steps_of(batch: pa.RecordBatch, end_class: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before and class of every token of a batch of class_sequences(), and where each row's tokens begin (and end)."""
    whole = batch.column("classes").cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    after = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int64) if len(whole) else np.zeros(0, np.int64)
    offsets = offsets - offsets[0]
    before = np.concatenate([[end_class], after[:-1]]) if len(after) else after
    before[offsets[:-1]] = end_class  # every row has its end at least
    return before, after, offsets


def transitions(sequences: DataFrame, model: Model) -> np.ndarray:
    """log10 P(class | class before) from the sequences that are learnt from."""
    n, end = len(model.mass), model.end_class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(n * n)
        for batch in batches:
            before, after, _ = steps_of(batch, end)
            cells += np.bincount(before * n + after, minlength=n * n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(cells.astype(np.int64))], names=["cell", "n"])

    got = sequences.where("learnt").select("classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    follows = np.zeros(n * n)
    follows[np.asarray(got["cell"])] = np.asarray(got["n"])
    follows = follows.reshape(n, n)
    return np.log10((follows + 0.5) / (follows.sum(axis=1, keepdims=True) + 0.5 * n))


def class_lm(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents that are not held out and scores all. base_score is an add-0.1 unigram model's, score the
    class model's log10 probability of the text. Null and empty texts are one token, the end. Without training
    documents, all words are unseen and base_score is 0. Null ids are carried; rows are scored each for itself, so
    repeated rows get equal scores (and count twice where they are learnt from). Very long texts are scored whole. A word
    that fits several classes equally takes the first. An empty table gives an empty table. Of other columns only those in
    held_out are read.
    """
    flagged = docs.select(F.struct(F.col(id_col).alias("id"), held_out.alias("held_out")).alias("who"), F.coalesce(~held_out, F.lit(False)).alias("learnt"), F.col(text_col).alias("t"))
    model, words = train(flagged.where("learnt").select("t"))
    sequences = stored(class_sequences(flagged, model, words), "lm-sequences")
    logs, end = transitions(sequences, model), model.end_class

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after, offsets = steps_of(batch, end)
            path = np.add.reduceat(logs[before, after], offsets[:-1]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("who", "n_tokens", "n_known", "base")), pa.array(path + np.asarray(batch.column("inner")))], names=["who", "n_tokens", "n_known", "base_score", "score"])

    out = sequences.mapInArrow(add_up, f"who {sequences.schema['who'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("who.id").alias(id_col), F.col("who.held_out").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
