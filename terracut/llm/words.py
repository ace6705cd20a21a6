"""Words of whole Arrow text batches as numpy arrays: positions and 64-bit fingerprints, without Python strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that separate words where punctuation counts as space: all ASCII but letters and digits.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[0x80:] = False
PUNCTUATION[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False
#: Bytes handled at once: bounds the temporary arrays (about 40 bytes for each byte of text).
BLOCK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power_table(which: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base or its inverse modulo 2**64, grown by doubling."""
    table = _powers[which]
    base = _BASE if which == "up" else _BASE_INVERSE
    while len(table) < n:
        step = np.uint64(pow(int(base), len(table), 1 << 64))
        table = np.concatenate([table, table * step])
    _powers[which] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the public splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of documents first .. first + len(counts) - 1 of a batch, in order."""

    first: int
    counts: np.ndarray  # words of each document
    starts: np.ndarray  # byte offsets into data
    ends: np.ndarray
    codes: np.ndarray  # uint64 fingerprints
    data: np.ndarray  # the block's bytes, uint8, as they are in the text

    @property
    def offsets(self) -> np.ndarray:
        """Word offsets of the documents, with the total at the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    @property
    def owners(self) -> np.ndarray:
        """The document (0-based in the block) of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs, raw


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; a longer document is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of data[start:end]: equal bytes, equal fingerprint, wherever they stand."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power_table("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the letters U+00C0 to U+00DE in UTF-8."""
    out = LOWER[data]
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    wide = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
    out[wide] += 0x20
    return out


def split_words(texts: pa.Array, fold: Callable[[np.ndarray], np.ndarray] | None = None, space: np.ndarray = SPACE, limit: int = BLOCK_BYTES) -> Iterator[Words]:
    """The words of every text, block by block. fold maps the bytes that fingerprints are taken from (lower_ascii: ignore case of A-Z)."""
    offsets, raw = text_buffers(texts)
    for i, j in blocks(offsets, limit):
        data = raw[offsets[i] : offsets[j]]
        bounds = offsets[i : j + 1] - offsets[i]
        inside = ~space[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(len(data), dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        counts = np.diff(np.searchsorted(starts, bounds))
        yield Words(i, counts, starts, ends, fingerprints(fold(data) if fold else data, starts, ends), data)


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of every k consecutive codes (len(codes) - k + 1 of them), whoever owns them."""
    n = max(0, len(codes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + codes[j : j + n]
    return mix(out)


def range_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums from which fold_range() takes fingerprints of any range of codes."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes) * _power_table("up", len(codes)), out=sums[1:])
    return sums


def fold_range(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of codes[start:end]: equal codes, equal fingerprint, wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _power_table("down", len(sums))[starts] + (ends - starts).astype(np.uint64))
