"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become sequences of word fingerprints (case and punctuation do not count). Items are a stated
query set: they go to the tasks in blocks of bounded size, and every document meets every block where it lies, without
a shuffle. Shared seeds (runs of `least` words) name the items that a document may hold; only items whose seeds cover
enough words are tiled. Tiling marks the longest match first, then the next longest among unmarked words, found by
running Karp-Rabin: window fingerprints of a falling length, each hit checked word by word. Tiles may come in any
order, so a passage with its sentences moved around is covered as well as a verbatim one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracut.llm.words import PUNCTUATION, Words, lower_latin, split_words, windows

#: Most words and bytes of benchmark text in one block, and so in a task's memory besides its batch.
BLOCK_ITEMS, BLOCK_TEXT_BYTES = 20_000, 8 << 20
RESULT = pa.schema([("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("item_words", pa.int64()), ("n_tiles", pa.int64()), ("tiles", pa.string())])


def sequences(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word fingerprints of each text, ignoring case and punctuation."""
    for block in split_words(texts, lower_latin, PUNCTUATION):
        offs = block.offsets
        for i in range(len(block.counts)):
            yield block.codes[offs[i] : offs[i + 1]]


def longest_matches(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """(length, text position, item position) of all maximal unmarked matches of at least s words."""
    if len(text) < s or len(item) < s:
        return []

    def open_windows(codes: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marked = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(marked[s:] == marked[:-s])
        return at, windows(codes, s)[at]

    at_text, in_text = open_windows(text, free_text)
    at_item, in_item = open_windows(item, free_item)
    order = np.argsort(in_item, kind="stable")
    in_item, at_item = in_item[order], at_item[order]
    lo, hi = np.searchsorted(in_item, in_text, "left"), np.searchsorted(in_item, in_text, "right")
    found = []
    for k in np.flatnonzero(hi > lo):
        p = int(at_text[k])
        for q in at_item[lo[k] : hi[k]]:
            q = int(q)
            if p and q and free_text[p - 1] and free_item[q - 1] and text[p - 1] == item[q - 1]:
                continue  # part of the match that begins one word earlier
            n = 0
            while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and free_text[p + n] and free_item[q + n]:
                n += 1
            if n >= s:
                found.append((n, p, q))
    return found


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, text position, item position) of non-overlapping tiles, longest first."""
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    s = max(least, len(item) // 2)
    while True:
        found = longest_matches(text, item, free_text, free_item, s)
        if not found:
            if s <= least:
                break
            s = max(least, s // 2)
            continue
        longest = max(n for n, _, _ in found)
        for n, p, q in sorted(m for m in found if m[0] == longest):
            if free_text[p : p + n].all() and free_item[q : q + n].all():
                free_text[p : p + n] = False
                free_item[q : q + n] = False
                tiles.append((n, p, q))
    return tiles


class Block:
    """Seeds of a block of benchmark items: where each seed stands in which items."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        self.least = least
        self.ids, self.items, self.short = [], [], {}
        for i, codes in zip(ids, sequences(pa.array(texts, pa.string())), strict=True):
            if len(codes):
                if len(codes) < least:
                    self.short.setdefault(len(codes), []).append((windows(codes, len(codes))[0], len(self.ids)))
                self.ids.append(i)
                self.items.append(codes.copy())
        self.short = {n: tuple(map(np.array, zip(*sorted(found), strict=True))) for n, found in self.short.items()}
        seeds = [windows(codes, least) for codes in self.items]
        self.seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds]).astype(np.int64)
        self.place = np.concatenate([np.arange(len(x)) for x in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.owner, self.place = self.seed[order], self.owner[order], self.place[order]
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.seed >> np.uint64(48)).astype(np.int64)] = True

    def held(self, text: np.ndarray, seeds: np.ndarray, share: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(item, tiles) of the items that tiles cover to the share. seeds: the text's seeds, those that the block may know."""
        seeds = np.unique(seeds)
        lo, hi = np.searchsorted(self.seed, seeds, "left"), np.searchsorted(self.seed, seeds, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True) if b > a] or [np.zeros(0, np.int64)])
        for k in np.unique(self.owner[at]):
            item = self.items[k]
            covered = np.zeros(len(item) + 1, np.int64)
            first = self.place[at[self.owner[at] == k]]
            np.add.at(covered, first, 1)
            np.add.at(covered, first + self.least, -1)
            if (np.cumsum(covered)[:-1] > 0).sum() >= share * len(item):  # else no tiles can
                tiles = tile(text, item, self.least)
                if sum(n for n, _, _ in tiles) >= share * len(item):
                    yield int(k), tiles

    def hits(self, texts: pa.Array, share: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item, tiles) for every text of a batch that holds an item of this block."""
        for block in split_words(texts, lower_latin, PUNCTUATION):
            seeds = windows(block.codes, self.least)
            maybe = np.flatnonzero(self.known[(seeds >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.seed, seeds[maybe]), max(0, len(self.seed) - 1))
            maybe = maybe[self.seed[at] == seeds[maybe]] if len(self.seed) else maybe[:0]
            offs = block.offsets
            rows = np.searchsorted(offs, maybe, "right") - 1
            inside = maybe + self.least <= offs[rows + 1]
            maybe, rows = maybe[inside], rows[inside]
            for row in np.unique(rows):
                for k, tiles in self.held(block.codes[offs[row] : offs[row + 1]], seeds[maybe[rows == row]], share):
                    yield block.first + int(row), k, tiles
            for n, (whole, items) in self.short.items():
                yield from self.short_hits(block, n, whole, items)

    def short_hits(self, block: Words, n: int, whole: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Items of n words, too few for a seed: texts that have these words in a row, at the first such place."""
        seen, offs = windows(block.codes, n), block.offsets
        lo, hi = np.searchsorted(whole, seen, "left"), np.searchsorted(whole, seen, "right")
        at = np.flatnonzero(hi > lo)
        rows = np.searchsorted(offs, at, "right") - 1
        at, rows = at[at + n <= offs[rows + 1]], rows[at + n <= offs[rows + 1]]
        found = set()
        for p, row in zip(at.tolist(), rows.tolist(), strict=True):
            for k in items[lo[p] : hi[p]].tolist():
                if (row, k) not in found and (block.codes[p : p + n] == self.items[k]).all():
                    found.add((row, k))
                    yield block.first + row, k, [(n, p - int(offs[row]), 0)]


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, least: int) -> Iterator[Block]:
    """The items in blocks of bounded size, read one partition at a time."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or held + len(row.t) > BLOCK_TEXT_BYTES):
            yield Block(ids, texts, least)
            ids, texts, held = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        held += len(row.t)
    yield Block(ids, texts, least)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 4, share: float = 0.5) -> DataFrame:
    """One row per document and benchmark item that it holds: id, item_id, coverage, matched_words, item_words, n_tiles, tiles.

    An item is held when tiles of at least `least` words cover `share` of its words. tiles: item word:document
    word:length, in item order. Null and empty texts hold nothing, and items without words are held by nothing; an item
    of fewer than `least` words is held where all its words stand in a row. Ties among equally long matches go to the earlier place in the document, then in the item. A null id
    is carried as it is; repeated rows give repeated results. Very long texts are searched whole. Only id_col and text_col
    are read, so other columns cannot clash. Item ids are whole numbers (others: TypeError). An empty documents or benchmark
    table gives an empty table.
    """
    if benchmark.schema[item_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{item_col} is no whole number")
    spark, narrow, parts = docs.sparkSession, docs.select(F.col(id_col), F.col(text_col)), []
    kind = pa.schema([("id", pa.int64()), *RESULT])
    ddl = f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, item_id bigint, coverage double, matched_words bigint, item_words bigint, n_tiles bigint, tiles string"
    for block in benchmark_blocks(benchmark, item_col, item_text_col, least):
        shipped = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            block = shipped.value
            for batch in batches:
                hits = list(block.hits(batch.column(1), share))
                sums = [sum(n for n, _, _ in t) for _, _, t in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r for r, _, _ in hits], pa.int64())),
                        pa.array([block.ids[k] for _, k, _ in hits], pa.int64()),
                        pa.array([n / len(block.items[k]) for n, (_, k, _) in zip(sums, hits, strict=True)], pa.float64()),
                        pa.array(sums, pa.int64()),
                        pa.array([len(block.items[k]) for _, k, _ in hits], pa.int64()),
                        pa.array([len(t) for _, _, t in hits], pa.int64()),
                        pa.array([",".join(f"{q}:{p}:{n}" for n, p, q in sorted(t, key=lambda x: x[2])) for _, _, t in hits], pa.string()),
                    ],
                    names=[id_col, *kind.names[1:]],
                )

        parts.append(narrow.mapInArrow(search, ddl))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 4, share: float = 0.5) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Decides as find_contamination() does, where the rows lie."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for block in benchmark_blocks(benchmark, item_col, item_text_col, least):
        shipped = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _, _ in shipped.value.hits(batch.column(at), share)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
