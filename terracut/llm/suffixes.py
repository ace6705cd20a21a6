"""Substring dedup over bytes by sorting suffixes: bytes of 100-byte strings that stand earlier in the corpus are removed.

Only suffixes whose first 100 bytes could stand twice are sorted, and equal ones meet in one task:

1. Every window of `width` bytes has an anchor, the least hash of its runs of GRAM bytes. Equal windows have equal
   anchors, so a window whose anchor no other run of windows has is unique, unless the anchor stands in its run twice. Anchors are counted; those of several runs go on.
2. The runs of windows with such an anchor (`spans`, some 140 bytes each) are cut from the texts and dealt by anchor.
3. A task sorts the suffixes that begin in its spans, up to `width` bytes, deep and shallow (see suffix_sort.py):
   multikey quicksort to a shallow depth, then blind tries for the groups that agree so far. Suffixes that agree in all
   bytes are equal windows; all but the first of the corpus are covered.

Equal spans of one batch are counted as one before they are exchanged. Anchors of more than HOT_RUNS runs (a common line
in many texts) are dealt by window instead, each batch sending one row for each of its windows, told by 128 bits. So no
task gets a group that grows with the corpus other than by one short row for each batch. Texts are exchanged compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracut.llm.scratch import stored
from terracut.llm.substrings import packed, unpacked
from terracut.llm.suffix_sort import classes
from terracut.llm.words import blocks, mix, text_buffers

#: Bytes whose hash may be an anchor.
GRAM = 16
#: Most windows of one span; longer runs are cut.
RUN = 256
#: An anchor of more runs than these is dealt by window.
HOT_RUNS = 1000
#: Bytes of text whose hashes are held at once.
BLOCK = 1 << 18
#: Bytes of spans that are sorted at once; spans of one anchor stay together.
CHUNK = 4 << 20
#: Values of the text's hash that tell texts of one id apart.
TEXT_PARTS = 1 << 16
#: A place: (start * RUN + windows - 1) * TEXT_PARTS + part of the text's hash; ordered by start.
PLACE = RUN * TEXT_PARTS


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as little-endian numbers (len(data) - 7 of them)."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    return x


def runs(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, anchor, start (in data) and windows of the maximal runs of windows with one anchor, cut at RUN windows.

    Last: whether the anchor's bytes stand in the run at more than one place; else no two of its windows are equal.
    """
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    w = words_at(data)
    least = hashes = mix(w[:-8] * np.uint64(0xD1342543DE82EF95) + w[8:])
    n, reach = width - GRAM + 1, 1
    while 2 * reach <= n:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < n:
        least = np.minimum(least[: reach - n], least[n - reach :])
    # Windows lie within one text: where one would pass the end of its text, a run ends and another begins at the next text.
    lasts = bounds[1:] - width
    whole = lasts >= bounds[:-1]
    edge = np.zeros(len(least) + 1, bool)
    edge[1:-1] = least[1:] != least[:-1]
    edge[bounds[:-1][whole]] = True
    edge[lasts[whole] + 1] = True
    start = np.flatnonzero(edge[:-1])
    end = np.append(start[1:], len(least))
    # A window that begins with its anchor, and the next one has it, too.
    twice = np.cumsum((hashes[: len(least)] == least) & ~edge[1:])
    again = twice[end - 1] - np.where(start > 0, twice[start - 1], 0) > 0
    owner = np.searchsorted(bounds, start, "right") - 1
    inside = start + width <= bounds[owner + 1]
    owner, start, n_all, again = owner[inside], start[inside], (end - start)[inside], again[inside]
    pieces = -(-n_all // RUN)
    part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    owner, start, left = np.repeat(owner, pieces), np.repeat(start, pieces) + part * RUN, np.repeat(n_all, pieces) - part * RUN
    return owner, least[start], start, np.minimum(left, RUN), np.repeat(again, pieces)


def anchors_of(docs: DataFrame, width: int) -> DataFrame:
    """anchor, n: one row for each anchor and batch, with its runs; those that may repeat a window themselves count twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = text_buffers(batch.column(0))
            found = [np.zeros(0, np.uint64)]
            for i, j in blocks(offsets, BLOCK):
                _, anchor, _, _, again = runs(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                found += [anchor, anchor[again]]
            anchor, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    return docs.select("t").mapInArrow(run, "anchor long, n long")


def spans_of(docs: DataFrame, width: int) -> DataFrame:
    """anchor, id, at: one row for each run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.asarray(batch.column(1)) & (TEXT_PARTS - 1)
            offsets, raw = text_buffers(batch.column(2))
            for i, j in blocks(offsets, BLOCK):
                bounds = offsets[i : j + 1] - offsets[i]
                owner, anchor, start, n, _ = runs(raw[offsets[i] : offsets[j]], bounds, width)
                at = (start - bounds[owner]) * PLACE + (n - 1) * TEXT_PARTS + part[owner + i]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column(0).take(pa.array(owner + i)), pa.array(at)], names=["anchor", "id", "at"])

    return docs.select("id", "hash", "t").mapInArrow(run, "anchor long, id long, at long")


def later(key: list[np.ndarray], ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether an earlier row (by id, then start) has the same key."""
    order = np.lexsort((start, ids, *key))
    lead = np.ones(len(order), bool)
    lead[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    first = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
    out = np.empty(len(order), bool)
    out[order] = (ids[order] != ids[order][first]) | (start[order] != start[order][first])
    return out


def prints(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (BLAKE2) of each window."""
    view = memoryview(data)
    bits = np.frombuffer(b"".join(hashlib.blake2b(view[s : s + width], digest_size=16).digest() for s in starts.tolist()), np.int64).reshape(-1, 2)
    return bits[:, 0], bits[:, 1]


#: What goes to the tasks that sort: span null, proof null: covered already; span null: a window; else a span.
SPANS = "bucket long, proof long, id long, at long, span binary"


def rows_of(bucket: np.ndarray, proof: np.ndarray | None, ids: np.ndarray, at: np.ndarray, span: list[bytes] | None) -> pa.RecordBatch:
    none = lambda t: pa.nulls(len(ids), t)
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), none(pa.int64()) if proof is None else pa.array(proof), pa.array(ids), pa.array(at), none(pa.binary()) if span is None else pa.array(span, pa.binary())], names=["bucket", "proof", "id", "at", "span"])


def covered_rows(ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Places that are settled: they meet nothing more, so any task may pass them on."""
    return rows_of(mix(at.astype(np.uint64) ^ mix(ids.astype(np.uint64))).view(np.int64), None, ids, at, None)


def cut_spans(texts: DataFrame, width: int) -> DataFrame:
    """The marked spans of every text (id, hash, n_bytes, packed, marks), equal ones of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unpacked(batch)[0]
            lists = batch.column("marks")
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            at, anchor, hot = (np.asarray(flat.field(c)) for c in ("at", "anchor", "hot"))
            hot = hot.astype(bool)
            ids, start, n, part = np.asarray(batch.column("id"))[row], at // PLACE, at // TEXT_PARTS % RUN + 1, at % TEXT_PARTS
            spans = [texts[r][s : s + k] for r, s, k in zip(row.tolist(), start.tolist(), (n + width - 1).tolist(), strict=True)]
            known: dict[bytes, int] = {}
            same = np.array([known.setdefault(s, len(known)) for s in spans], np.int64)
            old = later([same], ids, start)
            if old.any():
                yield covered_rows(ids[old], at[old])
            cold = np.flatnonzero(~old & ~hot)
            if len(cold):
                yield rows_of(anchor[cold], None, ids[cold], at[cold], [spans[i] for i in cold.tolist()])
            warm = np.flatnonzero(~old & hot)
            for low in range(0, len(warm), 2000):
                mine = warm[low : low + 2000]
                data = np.frombuffer(b"".join(spans[i] for i in mine.tolist()), np.uint8)
                sizes = n[mine] + width - 1
                begin = np.cumsum(sizes) - sizes
                step = np.arange(n[mine].sum()) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
                p, q = prints(data, np.repeat(begin, n[mine]) + step, width)
                own = np.repeat(ids[mine], n[mine])
                first = np.repeat(start[mine], n[mine]) + step
                place = first * PLACE + np.repeat(part[mine], n[mine])
                old = later([q, p], own, first)
                yield covered_rows(own[old], place[old])
                yield rows_of(p[~old], q[~old], own[~old], place[~old], None)

    return texts.mapInArrow(run, SPANS)


def repeats_gram(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether any GRAM bytes stand twice in each string from begin to end, as far as their hashes tell (never missed)."""
    n = np.maximum(end - begin - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(begin)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)
    w = words_at(np.concatenate([data, np.zeros(GRAM, np.uint8)]))
    grams = np.sort((mix(w[at] * np.uint64(0xD1342543DE82EF95) + w[at + 8]) >> np.uint64(24)) | (owner.astype(np.uint64) << np.uint64(40)))
    out = np.zeros(len(begin), bool)
    out[(grams[1:][grams[1:] == grams[:-1]] >> np.uint64(40)).astype(np.int64)] = True
    return out


def covered_by(chunk: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """id and at of the windows of a chunk of spans that stand earlier, too (runs of neighbours as one)."""
    spans = chunk["span"].combine_chunks().dictionary_encode()
    same, ids, at = np.asarray(spans.indices).astype(np.int64), np.asarray(chunk["id"]), np.asarray(chunk["at"])
    start, n, part = at // PLACE, at // TEXT_PARTS % RUN + 1, at % TEXT_PARTS
    old = later([same], ids, start)
    out_id, out_at = [ids[old]], [at[old]]
    # The first place of each different span; several texts of one id may have it at one place.
    order = np.lexsort((start, ids, same))
    firsts = order[np.concatenate([[True], same[order][1:] != same[order][:-1]])]
    texts = spans.dictionary
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begin, bucket = (offsets - offsets[0])[:-1], np.unique(np.asarray(chunk["bucket"])[firsts], return_inverse=True)[1]
    # An anchor's only span repeats no window unless the anchor stands in it twice.
    alone = np.flatnonzero(np.bincount(bucket)[bucket] == 1)
    open_spans = np.bincount(bucket)[bucket] > 1
    open_spans[alone] = repeats_gram(data, begin[alone], (offsets - offsets[0])[1:][alone])
    open_spans = np.flatnonzero(open_spans)
    count = n[firsts][open_spans]
    of = np.repeat(open_spans, count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    group = classes(data, begin[of] + step, bucket[of], width)
    hit = np.bincount(group, minlength=1)[group] > 1
    hit[hit] = later([group[hit]], ids[firsts][of[hit]], start[firsts][of[hit]] + step[hit])
    # What is covered in the first place of a span is so wherever the span stands.
    of, step = of[hit], step[hit]
    lead = np.ones(len(of), bool)
    lead[1:] = (of[1:] != of[:-1]) | (step[1:] != step[:-1] + 1)
    low = np.flatnonzero(lead)
    length = np.diff(np.append(low, len(of)))
    fresh = np.flatnonzero(~old)
    by_span = np.argsort(of[low], kind="stable")
    left, right = (np.searchsorted(of[low][by_span], same[fresh], side) for side in ("left", "right"))
    times = right - left
    row = np.repeat(fresh, times)
    pick = low[by_span[np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]]
    size = length[np.searchsorted(low, pick)]
    out_id.append(ids[row])
    out_at.append((start[row] + step[pick]) * PLACE + (size - 1) * TEXT_PARTS + part[row])
    return np.concatenate(out_id), np.concatenate(out_at)


def sorted_out(spans: DataFrame, width: int) -> DataFrame:
    """id, at of all covered runs of windows. Rows of one bucket come together, in order of proof, id and place."""
    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        held_bytes, last = 0, None  # bytes of spans that wait; the window before
        for batch in batches:
            table = pa.Table.from_batches([batch])
            proof, span = batch.column("proof"), batch.column("span")
            known = np.asarray(span.is_valid())
            one = np.asarray(proof.is_valid())
            done = ~known & ~one
            if done.any():
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(done)), batch.column("at").filter(pa.array(done))], names=["id", "at"])
            if one.any():
                p, q, ids, at = (np.asarray(batch.column(c).filter(pa.array(one))) for c in ("bucket", "proof", "id", "at"))
                lead = np.ones(len(p), bool)
                lead[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
                place = at // PLACE
                first = np.maximum.accumulate(np.where(lead, np.arange(len(p)), 0))
                first_id, first_place = ids[first], place[first]
                if last is not None and last[:2] == (p[0], q[0]):
                    head = first == 0
                    first_id[head], first_place[head] = last[2:]
                old = (ids != first_id) | (place != first_place)
                last = (p[-1], q[-1], first_id[-1], first_place[-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[old]), pa.array(at[old])], names=["id", "at"])
            if known.any():
                rows = table.filter(pa.array(known))
                bucket = np.asarray(rows["bucket"])
                while held_bytes + rows["span"].nbytes > most and len(rows):
                    # Up to the last change of bucket within the limit, or the first one after it.
                    change = np.flatnonzero(np.concatenate([[bool(held) and held[-1]["bucket"][-1].as_py() != bucket[0]], bucket[1:] != bucket[:-1]]))
                    if not len(change):
                        break
                    sizes = np.cumsum(np.asarray(pc.binary_length(rows["span"])))
                    fits = change[np.concatenate([[0], sizes])[change] + held_bytes <= most]
                    cut = int(fits[-1] if len(fits) else change[0])
                    chunk = pa.concat_tables([*held, rows.slice(0, cut)])
                    held, held_bytes = [], 0
                    rows, bucket = rows.slice(cut), bucket[cut:]
                    if len(chunk):
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, covered_by(chunk, width))), names=["id", "at"])
                if len(rows):
                    held.append(rows)
                    held_bytes += rows["span"].nbytes
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, covered_by(pa.concat_tables(held), width))), names=["id", "at"])

    return spans.mapInArrow(run, "id long, at long")


def per_text(marks: DataFrame, *fields: str) -> DataFrame:
    """marked_id, part, marks: a text's distinct marks, no more than it has bytes; repeated rows have them in common."""
    return marks.groupBy(F.col("id").alias("marked_id"), F.col("at").bitwiseAND(F.lit(TEXT_PARTS - 1)).alias("part")).agg(F.collect_set(F.struct("at", *fields)).alias("marks"))


def with_marks(texts: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    own = F.col("hash").bitwiseAND(F.lit(TEXT_PARTS - 1))
    return texts.withColumn("own_part", own).join(marks, (F.col("id") == F.col("marked_id")) & (F.col("own_part") == F.col("part")), how)


def kept_bytes(texts: DataFrame, width: int) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the bytes left) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = unpacked(batch)[0], batch.column("marks")
            sizes = np.asarray(batch.column("n_bytes"))
            removed, n_spans, kept = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), list(texts)
            for row in np.flatnonzero(np.asarray(lists.is_valid())).tolist():
                at = np.asarray(lists[row].values.field("at"))
                edge = np.zeros(sizes[row] + 1, np.int64)
                np.add.at(edge, at // PLACE, 1)
                np.add.at(edge, at // PLACE + at // TEXT_PARTS % RUN + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed[row] = gone.sum()
                n_spans[row] = gone[0] + np.count_nonzero(gone[1:] & ~gone[:-1])
                kept[row] = np.frombuffer(texts[row], np.uint8)[~gone].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(removed), pa.array(n_spans), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.select("id", "n_bytes", "packed", "marks").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (runs of removed bytes), kept (binary: the bytes that stay).

    Texts are UTF-8 bytes. A byte is removed if some `width` bytes that cover it, within the text, also start earlier:
    in a document with a smaller id or further ahead in the same one, as the input has it; the two may overlap. Null and
    empty texts have no bytes. A row with a null id keeps all and counts for no other. Rows of one id are one document:
    what starts at the same place of several is in neither removed for the other's sake. Very long texts are read
    whole. An empty table gives an empty table. Ids are whole numbers (others: TypeError). Only id_col and text_col are
    read, so other columns cannot clash.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} is no whole number")
    if width < GRAM:
        raise ValueError(f"width is {GRAM} at least")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    known = docs.where("id IS NOT NULL")
    shared = anchors_of(known, width).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    shared = stored(shared.select("anchor", (F.col("n") > HOT_RUNS).alias("hot")), "shared-anchors")
    marks = stored(spans_of(known, width).join(shared, "anchor"), "marked-spans")
    texts = packed(docs)
    spans = cut_spans(with_marks(texts, per_text(marks, "anchor", "hot"), "inner").select("id", "hash", "n_bytes", "packed", "marks"), width)
    covered = stored(sorted_out(spans.repartition("bucket").sortWithinPartitions("bucket", "proof", "id", "at"), width), "covered-windows")
    return kept_bytes(with_marks(texts, per_text(covered), "left"), width).withColumnRenamed("id", id_col)
