"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade y in 0 .. K-1 has P(y <= k) = sigmoid(theta_k - w.x), with one weight vector w for all grades and
ordered thresholds theta. x: presence, single and repeated, of hashed words and beginnings of words (case and
punctuation do not count), and a few shape statistics. The expected grade and the tail probability P(y >= k) follow, and
selection is by the tail.

The fit reads at most `max_labelled` labelled documents, chosen by a hash of their id; all else covers every row. Scoring
is a map over the documents with the weights (2**bits floats, a fixed size) at hand, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracut.llm.words import PUNCTUATION, fingerprints, lower_ascii, lower_latin, mix, split_words

MAX_LABELLED = 8_000
BITS = 20
#: Share of the rated documents that must have a feature for it to get a weight (10 of MAX_LABELLED).
LEAST_SHARE = 1.25e-3
#: Bytes of word beginnings, and how often a word or beginning must occur for its further features.
PREFIXES, COUNTS = (4, 5, 6, 7), (2, 4, 8)
#: What is kept: grade 2 (good and clean) with this probability.
LEAST_GRADE, LEAST_TAIL = 2, 0.85
SHAPES = 10
#: Entries of the sample that are summed up at once.
SEGMENTS = 1 << 20


@dataclass
class Model:
    words: np.ndarray  # float32, one weight for each hashed word
    shapes: np.ndarray
    centre: np.ndarray  # mean and spread of the shape statistics in the sample
    spread: np.ndarray
    thresholds: np.ndarray  # ordered

    def score(self, x: "Features") -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and P(y >= k) for k = 1 .. K-1 in columns."""
        z = np.zeros(len(x.offsets) - 1)
        full = np.flatnonzero(np.diff(x.offsets))
        if len(full):
            z[full] = np.add.reduceat(self.words[x.words], x.offsets[full])
        z += ((x.shapes - self.centre) / self.spread) @ self.shapes
        tails = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -500, 500)))
        return tails.sum(axis=1), tails


@dataclass
class Features:
    offsets: np.ndarray
    words: np.ndarray  # hashed features of each document, once each
    shapes: np.ndarray


def shape_statistics(texts: pa.Array) -> np.ndarray:
    """Shares of kinds of words in each text: shouted, ending in ! or a symbol, lone symbols, repeated, after an equal word, and so on."""
    out = []
    for b in split_words(texts, lower_ascii):
        n, offs = len(b.counts), b.offsets
        size = np.maximum(b.counts, 1)
        data, last, first = b.data, b.data[b.ends - 1] if len(b.ends) else b.data[:0], b.data[b.starts] if len(b.starts) else b.data[:0]
        length = b.ends - b.starts
        upper = (data >= 65) & (data <= 90)
        ups = np.concatenate([[0], np.cumsum(upper)])
        in_upper = ups[b.ends] - ups[b.starts]
        owner = b.owners
        per = lambda flag, owner=owner, n=n: np.bincount(owner, weights=flag.astype(float), minlength=n)
        again = np.zeros(len(b.codes), bool)
        again[1:] = (b.codes[1:] == b.codes[:-1]) & (owner[1:] == owner[:-1])
        distinct = np.array([len(np.unique(b.codes[offs[i] : offs[i + 1]])) for i in range(n)], float)
        alnum = ~PUNCTUATION
        cols = [
            per(last == ord("!")) / size,
            per(np.isin(last, np.frombuffer(b"#$%&*@~^+=<>", np.uint8))) / size,
            per(~alnum[first] & (length == 1)) / size,
            per((in_upper >= 2) & (in_upper * 2 >= length)) / size,
            per(again) / size,
            np.where(b.counts > 0, 1 - distinct / size, 0),
            per(length.astype(float)) / size / 10,
            np.log1p(b.counts) / 10,
            per((first >= 48) & (first <= 57)) / size,
            (b.counts < 6).astype(float),
        ]
        out.append(np.stack(cols, axis=1))
    return np.concatenate(out) if out else np.zeros((0, SHAPES))


def features(texts: pa.Array, bits: int = BITS) -> Features:
    """Hashed words and beginnings of words (of PREFIXES bytes), each once for a text at every count of COUNTS that it reaches."""
    words, counts = [], []
    for b in split_words(texts, lower_latin, PUNCTUATION):
        owner, codes = [b.owners], [b.codes]
        folded, length = lower_latin(b.data), b.ends - b.starts
        for k in PREFIXES:
            longer = np.flatnonzero(length > k)
            owner.append(owner[0][longer])
            codes.append(fingerprints(folded, b.starts[longer], b.starts[longer] + k) ^ np.uint64(k))
        hashed = mix(np.concatenate(codes) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)
        pairs, times = np.unique((np.concatenate(owner) << bits) | hashed.astype(np.int64), return_counts=True)
        reached = [pairs]
        for n in COUNTS:
            often = pairs[times >= n]
            again = mix((often & ((1 << bits) - 1)).astype(np.uint64) * np.uint64(n)) >> np.uint64(64 - bits)
            reached.append((often >> bits << bits) | again.astype(np.int64))
        pairs = np.unique(np.concatenate(reached))
        words.append((pairs & ((1 << bits) - 1)).astype(np.int32))
        counts.append(np.bincount(pairs >> bits, minlength=len(b.counts)))
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return Features(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.concatenate(words) if words else np.zeros(0, np.int32), shape_statistics(texts))


def neighbours(x: Features, vocabulary: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """The vocabulary's words in order of documents (word, documents that have any, where each begins) and, sorted once, of words
    (document, where each word begins): sums by either are sums of neighbours."""
    column = np.full(1 << bits, -1, np.int32)
    column[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    cols = column[x.words]
    used = cols >= 0
    owner = np.repeat(np.arange(len(x.offsets) - 1, dtype=np.int32), np.diff(x.offsets))[used]
    cols = cols[used]
    length = np.bincount(owner, minlength=len(x.offsets) - 1)
    full = np.flatnonzero(length)
    # In place, as these are the largest arrays of the fit.
    by_word = np.argsort(cols, kind="stable")
    owner = owner[by_word]
    del by_word
    often = np.bincount(cols, minlength=len(vocabulary))
    return cols, full, (np.cumsum(length) - length)[full], owner, np.cumsum(often) - often


def segment_sums(values: np.ndarray, index: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """np.add.reduceat(values[index], begin), some SEGMENTS entries at a time."""
    out, end = np.empty(len(begin)), np.append(begin[1:], len(index))
    low = 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(end, begin[low] + SEGMENTS, "right")))
        out[low:high] = np.add.reduceat(values[index[begin[low] : end[high - 1]]], begin[low:high] - begin[low])
        low = high
    return out


def fit(x: Features, grades: np.ndarray, n_grades: int, bits: int = BITS, steps: int = 250, rate: float = 0.05, sparse: float = 5e-5, least_share: float = LEAST_SHARE) -> Model:
    """Maximum likelihood with an L1 penalty on words, by proximal Adam steps over the whole sample. Deterministic.

    Features of fewer than least_share of the documents, or of a single one, get no weight.
    """
    n = len(grades)
    centre, spread = x.shapes.mean(axis=0) if n else np.zeros(SHAPES), x.shapes.std(axis=0) + 1e-3 if n else np.ones(SHAPES)
    vocabulary = np.flatnonzero(np.bincount(x.words, minlength=1 << bits) >= max(2, least_share * n))
    m = len(vocabulary)
    cols, full, begin, word_owner, word_begin = neighbours(x, vocabulary, bits)
    shapes = (x.shapes - centre) / spread
    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 1.0)[:-1] / (n + n_grades)
    # theta_0, then the logs of the gaps, keep thresholds in order.
    theta = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(m + SHAPES), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    first, second = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(n)
    for step in range(1, steps + 1 if n else 1):
        gaps = np.exp(p[m + SHAPES + 1 :])
        theta = np.concatenate([p[m + SHAPES : m + SHAPES + 1], p[m + SHAPES] + np.cumsum(gaps)])
        z = shapes @ p[m : m + SHAPES]
        if m:
            z[full] += segment_sums(p, cols, begin)
        cdf = 1 / (1 + np.exp(np.clip(z[:, None] - theta[None, :], -30, 30)))
        padded = np.concatenate([np.zeros((n, 1)), cdf, np.ones((n, 1))], axis=1)
        slope = padded * (1 - padded)
        like = np.maximum(padded[at, grades + 1] - padded[at, grades], 1e-12)
        up, down = slope[at, grades + 1] / like, slope[at, grades] / like
        dz = (up - down) / n
        dtheta = np.bincount(grades, weights=-up, minlength=n_grades)[:-1] / n + np.bincount(grades, weights=down, minlength=n_grades)[1:] / n
        g = np.concatenate([segment_sums(dz, word_owner, word_begin), shapes.T @ dz, [dtheta.sum()], [dtheta[k + 1 :].sum() * gaps[k] for k in range(len(gaps))]])
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        pace = rate / (np.sqrt(second / (1 - 0.99**step)) + 1e-4)
        p -= pace * first / (1 - 0.9**step)
        p[:m] = np.sign(p[:m]) * np.maximum(np.abs(p[:m]) - pace[:m] * sparse, 0)
    gaps = np.exp(p[m + SHAPES + 1 :])
    theta = np.concatenate([p[m + SHAPES : m + SHAPES + 1], p[m + SHAPES] + np.cumsum(gaps)])
    words = np.zeros(1 << bits, np.float32)
    words[vocabulary] = p[:m]
    return Model(words, p[m : m + SHAPES], centre, spread, theta)


def train(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, grade_col: str, n_grades: int, max_labelled: int = MAX_LABELLED, bits: int = BITS) -> Model:
    """Fit on the rated documents; at most max_labelled ratings, by a hash of their id.

    Ratings without an id or a grade are left out; of several grades of one id the lowest counts. Null and empty texts are
    texts without words. Repeated rows of a rated document count once, and of its different texts the one of the least
    hash, so one task fits max_labelled rows at most, and the driver gets the weights. Very long texts are read whole. Without rated documents (empty tables too) the model has no weights, and thresholds of equal shares. Only the
    named columns are read, so others cannot clash.
    """
    chosen = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
    chosen = chosen.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2), bits)
            words = pa.ListArray.from_arrays(pa.array(x.offsets, pa.int32()), pa.array(x.words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, pa.array(list(x.shapes), pa.list_(pa.float64()))], names=["place", "grade", "words", "shapes"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("grade")), np.asarray(b.column("words").value_lengths()), np.asarray(b.column("words").flatten()), np.asarray(b.column("shapes").flatten())) for b in batches if b.num_rows]
        if parts:
            grades, sizes, words, shapes = (np.concatenate(p) for p in zip(*parts))
            del parts
            x = Features(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), words, shapes.reshape(-1, SHAPES))
            model = fit(x, grades.astype(np.int64), n_grades, bits)
            small = [pa.array([v.astype(float).tolist()], pa.list_(pa.float64())) for v in (model.shapes, model.centre, model.spread, model.thresholds)]
            yield pa.RecordBatch.from_arrays([pa.array([model.words.tobytes()], pa.binary()), *small], names=["words", "shapes", "centre", "spread", "thresholds"])

    # chosen has at most max_labelled rows of two numbers.
    rated = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")
    rated = rated.groupBy("id").agg(F.min("grade").alias("grade"), F.min_by("t", F.xxhash64("t")).alias("t")).select(F.xxhash64("id").alias("place"), "grade", "t")
    # The sample is fitted by one task, in a fixed order; the driver gets the weights alone.
    sample = rated.mapInArrow(extract, "place long, grade int, words array<int>, shapes array<double>").repartition(1).sortWithinPartitions("place")
    got = sample.mapInArrow(fitted, "words binary, shapes array<double>, centre array<double>, spread array<double>, thresholds array<double>").collect()
    if not got:
        return fit(Features(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros((0, SHAPES))), np.zeros(0, np.int64), n_grades, bits)
    return Model(np.frombuffer(bytes(got[0]["words"]), np.float32), *(np.asarray(got[0][k], float) for k in ("shapes", "centre", "spread", "thresholds")))


def score(docs: DataFrame, model: Model, id_col: str, text_col: str, least_grade: int, least_tail: float, bits: int = BITS) -> DataFrame:
    """One row per document: id, expected_grade, tail (P(grade >= least_grade)) and kept (tail >= least_tail).

    Null and empty texts are scored as texts without words, very long ones whole. Null ids are carried; repeated rows get
    equal scores. A tail equal to least_tail is kept. An empty table gives an empty table. Only id_col and text_col are
    read, so other columns cannot clash.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grade, tails = shipped.value.score(features(batch.column(1), bits))
            tail = tails[:, least_grade - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grade), pa.array(tail), pa.array(tail >= least_tail)], names=[id_col, "expected_grade", "tail", "kept"])

    narrow = docs.select(id_col, text_col)
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, expected_grade double, tail double, kept boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str, least_grade: int, least_tail: float, bits: int = BITS) -> DataFrame:
    """The documents that score() keeps, with all their columns, whatever their names; repeated rows stay or go together."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = shipped.value.score(features(batch.column(at), bits))[1]
            yield batch.filter(pa.array(tails[:, least_grade - 1] >= least_tail))

    return docs.mapInArrow(run, docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 for low quality, 1 for good but toxic, 2 for good and clean; null where a label is missing."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
