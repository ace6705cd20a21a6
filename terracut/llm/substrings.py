"""Substring dedup by recompression: words of long passages that an earlier document has already are removed.

Recompression (see recompress.py) cuts a repeated passage into the same symbols wherever it stands. Spark compares them
from the top down; each step leaves less to the next:

1. long symbols, of two to some dozen windows: a symbol whose words an earlier document has too is
   covered as a whole. What is compared is a digest of the words. Long repeats are settled here, by few rows.
2. anchors: windows of `width` words that no long symbol covers have an interior symbol of a low level as their anchor.
   Only anchors of two documents or more go on.
3. spans: the words from the first to the last of a document's windows of one anchor, as a fingerprint. A span that an
   earlier document has too is covered.
4. windows: where one anchor has several spans, their windows are compared one by one, those of each span's first
   document only, as later ones are settled by step 3.

The first document that has a window never covers it by step 1, nor does any document for which it is a new repeat. So
steps 2 to 4 find all that step 1 leaves. Counts and minima are taken in part before each exchange. Hot symbols and
anchors meet in joins, whose partitions adaptive execution splits, or where that cannot be, in a broadcast of those few
that hold a stated share of all rows. Texts are exchanged compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracut.llm.recompress import anchor_runs, long_symbols
from terracut.llm.scratch import stored
from terracut.llm.words import SPACE, Words, fold_range, mix, range_sums, split_words

#: Bits of an anchor that are compared. More than one anchor may share them; that costs a comparison, and no result.
ANCHOR_BITS = 40
#: Share of all spans that makes an anchor hot; at most 1 / HOT_SHARE anchors are.
HOT_SHARE = 1e-4
#: Values of the text's hash that tell marks of several texts of one id apart (each mark is checked on the words, too).
TEXT_PARTS = 1 << 16


def joined_words(b: Words) -> tuple[np.ndarray, memoryview]:
    """All words of a block with one space behind each, and where each begins (with the end)."""
    size = b.ends - b.starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 0x20, np.uint8)
    inside = np.flatnonzero(~SPACE[b.data])
    out[inside + np.repeat(at[:-1] - b.starts, size)] = b.data[inside]
    return at, memoryview(out)


def symbols_of(docs: DataFrame, width: int) -> DataFrame:
    """d1, d2 (digest of the words), id, hash, start, n (words) of the long symbols of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in split_words(batch.column(2)):
                start, n = long_symbols(b.codes, b.offsets, width)
                at, text = joined_words(b)
                digests = b"".join(hashlib.blake2b(text[i : j - 1], digest_size=16).digest() for i, j in zip(at[start].tolist(), at[start + n].tolist(), strict=True))
                d = np.frombuffer(digests, np.int64).reshape(-1, 2)
                owner = np.searchsorted(b.offsets, start, "right") - 1
                rows = pa.array(owner + b.first)
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start - b.offsets[owner]), pa.array(n)], names=["d1", "d2", "id", "hash", "start", "n"])

    return docs.select("id", "hash", "t").mapInArrow(run, f"d1 long, d2 long, id {docs.schema['id'].dataType.simpleString()}, hash long, start long, n long")


def packed(docs: DataFrame) -> DataFrame:
    """id, hash, n_bytes and the compressed text (null counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            raw = pc.fill_null(batch.column(2), "").cast(pa.binary())
            sizes = pc.binary_length(raw).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array([codec.compress(x.as_buffer(), asbytes=True) for x in raw], pa.binary())], names=["id", "hash", "n_bytes", "packed"])

    return docs.select("id", "hash", "t").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, hash long, n_bytes long, packed binary")


def unpacked(batch: pa.RecordBatch) -> tuple[list[bytes], pa.Array]:
    """The texts of packed(), each for itself and as one array."""
    codec, sizes = pa.Codec("zstd"), batch.column("n_bytes").to_numpy()
    texts = [codec.decompress(x, n, asbytes=True) for x, n in zip(batch.column("packed").to_pylist(), sizes.tolist(), strict=True)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return texts, pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(b"".join(texts)))


def ranges_of(lists: pa.Array, b: Words) -> tuple[np.ndarray, np.ndarray, slice]:
    """For the lists of a block's texts: the text (0-based in the block) of each entry, all texts' entries so far, and the block's part of them."""
    held = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    mine = held[b.first : b.first + len(b.counts) + 1]
    return np.repeat(np.arange(len(b.counts)), np.diff(mine)), held, slice(mine[0], mine[-1])


def covers_of(batch: pa.RecordBatch, b: Words) -> tuple[np.ndarray, np.ndarray]:
    """Start (word number in the block) and words of what long symbols cover."""
    owner, _, here = ranges_of(batch.column("covers"), b)
    flat = batch.column("covers").flatten()
    return b.offsets[owner] + flat.field("start").to_numpy()[here], flat.field("n").to_numpy()[here]


def open_runs(batch: pa.RecordBatch, b: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor_runs() of the windows that lie in no cover."""
    start, n = covers_of(batch, b)
    edge = np.zeros(len(b.codes) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n - width + 1, -1)
    return anchor_runs(b.codes, b.offsets, width, np.cumsum(edge)[:-1] > 0)


def anchors_of(covered: DataFrame, width: int) -> DataFrame:
    """anchor: one row for each anchor of a document's open windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in split_words(unpacked(batch)[1]):
                owner, anchor, _, _ = open_runs(batch, b, width)
                pairs = np.unique((anchor >> np.uint64(64 - ANCHOR_BITS) << np.uint64(64 - ANCHOR_BITS)) | owner.astype(np.uint64))  # a block has fewer documents than 2**24 bytes
                yield pa.RecordBatch.from_arrays([pa.array((pairs >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64))], names=["anchor"])

    return covered.select("n_bytes", "packed", "covers").mapInArrow(run, "anchor long")


def spans_of(covered: DataFrame, width: int) -> DataFrame:
    """anchor, span, id, at of every run of open windows with one anchor.

    at: (start * width + number of windows - 1) * TEXT_PARTS + the part of the text's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.asarray(batch.column("hash")) & (TEXT_PARTS - 1)
            for b in split_words(unpacked(batch)[1]):
                owner, anchor, start, n = open_runs(batch, b, width)
                span = fold_range(range_sums(b.codes), start, start + n + width - 1)
                ids = batch.column("id").take(pa.array(owner + b.first))
                at = ((start - b.offsets[owner]) * width + n - 1) * TEXT_PARTS + part[owner + b.first]
                yield pa.RecordBatch.from_arrays([pa.array((anchor >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64)), pa.array(span.view(np.int64)), ids, pa.array(at)], names=["anchor", "span", "id", "at"])

    return covered.select("id", "hash", "n_bytes", "packed", "covers").mapInArrow(run, f"anchor long, span long, id {covered.schema['id'].dataType.simpleString()}, at long")


@dataclass
class Marked:
    """A block of texts with those of their marks whose words are in the text: where rows of one id have different texts,
    a mark may be another's."""

    words: Words
    sums: np.ndarray
    owner: np.ndarray  # the mark's document, 0-based in the block
    start: np.ndarray  # word number in the block
    n: np.ndarray  # windows


def marked(batch: pa.RecordBatch, texts: pa.Array, width: int) -> Iterator[Marked]:
    flat = batch.column("marks").flatten()
    at, prints = flat.field("at").to_numpy() // TEXT_PARTS, flat.field("span").to_numpy().view(np.uint64)
    for b in split_words(texts):
        owner, _, here = ranges_of(batch.column("marks"), b)
        start, n, wanted = at[here] // width, at[here] % width + 1, prints[here]
        inside = start + n + width - 1 <= b.counts[owner]
        owner, n, wanted = owner[inside], n[inside], wanted[inside]
        start, sums = b.offsets[owner] + start[inside], range_sums(b.codes)
        same = fold_range(sums, start, start + n + width - 1) == wanted
        yield Marked(b, sums, owner[same], start[same], n[same])


def windows_of(texts: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """w1, w2 (two fingerprints), id, at: every window in the marked spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in marked(batch, unpacked(batch)[1], width):
                first = np.unique(np.repeat(m.start, m.n) + np.arange(m.n.sum()) - np.repeat(np.cumsum(m.n) - m.n, m.n))
                owner = np.searchsorted(m.words.offsets, first, "right") - 1
                one = fold_range(m.sums, first, first + width)
                two = fold_range(range_sums(mix(m.words.codes ^ np.uint64(0x6A09E667F3BCC909))), first, first + width)
                ids = batch.column("id").take(pa.array(owner + m.words.first))
                part = np.asarray(batch.column("hash"))[owner + m.words.first] & (TEXT_PARTS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), ids, pa.array((first - m.words.offsets[owner]) * width * TEXT_PARTS + part)], names=["w1", "w2", "id", "at"])

    kind = texts.schema["id"].dataType.simpleString()
    return with_marks(texts, marks, "inner").select("id", "hash", "n_bytes", "packed", "marks").mapInArrow(run, f"w1 long, w2 long, id {kind}, at long")


def per_text(marks: DataFrame) -> DataFrame:
    """id, part, marks: a text's distinct marks, no more than it has words; repeated rows have them in common."""
    return marks.groupBy("id", F.col("at").bitwiseAND(F.lit(TEXT_PARTS - 1)).alias("part")).agg(F.collect_set(F.struct("at", "span")).alias("marks"))


def with_marks(texts: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    texts, marks = texts.withColumn("own_part", F.col("hash").bitwiseAND(F.lit(TEXT_PARTS - 1))), marks.withColumnRenamed("id", "marked_id")
    return texts.join(marks, (F.col("id") == F.col("marked_id")) & (F.col("own_part") == F.col("part")), how)


def kept_words(texts: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by one space) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, together = unpacked(batch)
            stays: dict[int, list[bool]] = {}
            if len(batch.column("marks").flatten()) or len(batch.column("covers").flatten()):
                for m in marked(batch, together, width):
                    start, n = covers_of(batch, m.words)
                    edge = np.zeros(len(m.words.codes) + 1, np.int64)
                    np.add.at(edge, m.start, 1)
                    np.add.at(edge, m.start + m.n + width - 1, -1)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n, -1)
                    free, offs = np.cumsum(edge)[:-1] == 0, m.words.offsets
                    touched = np.unique(np.concatenate([m.owner, np.searchsorted(offs, start, "right") - 1]))
                    stays |= {m.words.first + d: free[offs[d] : offs[d + 1]].tolist() for d in touched.tolist()}
            all_words, removed, kept = [], [], []
            for row, text in enumerate(texts):
                words = text.split()  # at the same six bytes as split_words()
                left = list(compress(words, stays[row])) if row in stays else words
                all_words.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(all_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    kind = texts.schema["id"].dataType.simpleString()
    return with_marks(texts, marks, "left").select("id", "n_bytes", "packed", "covers", "marks").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are separated by ASCII white space. A word is removed if some window of `width` words that covers it also
    starts in a document with a smaller id, as the input has it. Null and empty texts have no words. A row with a null
    id keeps all words and counts for no other. Repeated rows (one id) never remove each other's words; where their
    texts differ, each text keeps its own result. Very long texts are read whole. Repeats within a document stay. An
    empty table gives an empty table. Only id_col and text_col are read, so other columns cannot clash.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    symbols = stored(symbols_of(docs.where("id IS NOT NULL"), width), "long-symbols")
    held = symbols.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").select("d1", "d2", "first")
    covers = symbols.join(held, ["d1", "d2"]).where("id > first").groupBy(F.col("id").alias("covered_id"), F.col("hash").alias("covered_hash")).agg(F.collect_set(F.struct("start", "n")).alias("covers"))
    texts = packed(docs).join(covers, (F.col("id") == F.col("covered_id")) & (F.col("hash") == F.col("covered_hash")), "left")
    covered = stored(texts.select("id", "hash", "n_bytes", "packed", "covers"), "covered-texts")
    known = covered.where("id IS NOT NULL")
    # A table of its own, so that both sides of the next join are plain exchanges, which adaptive execution splits where hot.
    shared = stored(anchors_of(known, width).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "shared-anchors")
    spans = stored(spans_of(known, width).join(shared, "anchor", "left_semi"), "shared-spans")
    firsts = with_several(spans.groupBy("anchor", "span").agg(F.min("id").alias("first")), spans)
    placed = stored(spans.join(firsts, ["anchor", "span"]).where("id > first OR several").select("id", "at", "span", (F.col("id") > F.col("first")).alias("sure")), "placed-spans")
    windows = stored(windows_of(covered, per_text(placed.where("NOT sure")), width), "windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min("id").alias("first"))
    repeated = windows.join(earliest, ["w1", "w2"]).where("id > first").select("id", "at", F.col("w1").alias("span"))
    out = kept_words(covered, per_text(placed.where("sure").select("id", "at", "span").unionAll(repeated)), width)
    return out.withColumnRenamed("id", id_col)


def with_several(firsts: DataFrame, spans: DataFrame) -> DataFrame:
    """firsts (anchor, span, first) with several: whether the anchor has more than one span."""
    per_anchor = stored(spans.groupBy("anchor").agg(F.min("span").alias("least"), F.max("span").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("anchor", "n"), "several-spans")
    total = spans.count()
    # At most 1 / HOT_SHARE rows.
    hot = F.broadcast(per_anchor.where(F.col("n") > total * HOT_SHARE).select("anchor", F.lit(True).alias("hot")))
    cool = per_anchor.where(F.col("n") <= total * HOT_SHARE).select("anchor", F.lit(True).alias("cool"))
    dealt = firsts.join(hot, "anchor", "left")
    rest = dealt.where("hot IS NULL").join(cool, "anchor", "left").select("anchor", "span", "first", F.col("cool").isNotNull().alias("several"))
    return rest.unionAll(dealt.where("hot").select("anchor", "span", "first", F.lit(True).alias("several")))
