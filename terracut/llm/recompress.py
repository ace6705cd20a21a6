"""Recompression of word sequences: long symbols, and the interior symbols that equal windows share.

Rounds of recompression name maximal runs of a word, then pairs of neighbouring symbols: a hash deals symbols to a left
and a right half, anew in each round, and every left symbol followed by a right one becomes one symbol. Names are
fingerprints of what they stand for, so equal substrings get equal names in every task of the cluster; what a symbol of
a high level stands for, Spark compares by a digest of the words themselves.

A repeated passage is cut into the same symbols wherever it stands, but for its margins. long_symbols() gives symbols of
high levels, those that reach a number of words first: equal ones reveal long repeats. For the margins, and for repeats
too short to hold such a symbol, window_anchors() gives each window a low symbol inside it.

Every low symbol carries the words that decided it: its own and those of neighbours that were looked at. Where all of them
lie within a window, the symbol is interior to the window, and any other place with the same words has it too. A
window's anchor is, of its interior symbols of the highest level that has one, the one that comes first in a hash order
(failing all levels, the window itself). Equal windows have equal anchors, so only windows with a shared anchor can
repeat; and neighbouring windows mostly share theirs, so there are far fewer anchors than windows.
"""

from __future__ import annotations

import numpy as np

from terracut.llm.words import fold_range, mix, range_sums, windows

#: Rounds of pairing for anchors. A symbol of level 2 spans two words or more and is decided by about five.
LEVELS = 2
#: Rounds of pairing for long symbols (each leaves three quarters of the symbols) and their least lengths in windows: for
#: windows of 13 words, symbols of 26 words or more have about 40, those of 416 or more about 600.
LONG_LEVELS, LONG_WINDOWS = 24, (2, 8, 32)


def named_runs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, context (from, to) and "first of its document" of the maximal runs of equal words. first: a document begins.

    The context of a run is the run and one word on either side, which show that it ends there: words from to to - 1.
    """
    n = len(codes)
    head = np.ones(n, bool)
    head[1:] = (codes[1:] != codes[:-1]) | first[1:]
    at = np.flatnonzero(head)
    end = np.append(at[1:], n)
    size = (end - at).astype(np.uint64)
    name = np.where(size > 1, mix(codes[at] * np.uint64(0xA24BAED4963EE407) + size), codes[at])
    return name, at - 1, end + 1, first[at]


def is_right(name: np.ndarray, salt: int) -> np.ndarray:
    """Whether a symbol is of the right half in the round of this number."""
    return (mix(name ^ np.uint64(0x9E3779B97F4A7C15 * (2 * salt + 1) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)


def pair_name(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    return mix(left * np.uint64(0x8CB92BA72F3D8DD7) + mix(right + np.uint64(salt)))


def paired(name: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round: left symbols followed by right ones become one symbol."""
    n = len(name)
    right = is_right(name, salt)
    joined = np.zeros(n + 1, bool)  # joined[i]: i - 1 and i are one
    joined[1:n] = ~right[:-1] & right[1:] & ~first[1:]
    after, before = joined[1:], joined[:-1]
    new_hi, new_lo = hi.copy(), lo.copy()
    # A left symbol that stays alone looked at the next one, a right one at the one before, or past the document's edge.
    last = np.append(first[1:], True)
    alone = ~after & ~before
    look = np.flatnonzero(alone & ~right)
    new_hi[look] = np.where(last[look], hi[look] + 1, hi[np.minimum(look + 1, n - 1)])
    look = np.flatnonzero(alone & right)
    new_lo[look] = np.where(first[look], lo[look] - 1, lo[np.maximum(look - 1, 0)])
    both = np.flatnonzero(after)
    new_hi[both] = hi[both + 1]
    new_name = name.copy()
    new_name[both] = pair_name(name[both], name[both + 1], salt)
    keep = ~before
    return new_name[keep], new_lo[keep], new_hi[keep], first[keep]


def long_symbols(codes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (word number) and number of words of the long symbols: for each least length, those that reach it first."""
    n, counts = len(codes), np.diff(offsets)
    starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first = np.zeros(n, bool)
    first[offsets[:-1][counts > 0]] = True
    name, lo, _, first = named_runs(codes, first) if n else (codes, offsets[:0], None, first)
    begin = lo + 1
    size = np.diff(np.append(begin, n))
    largest = np.zeros(len(begin), np.int64)  # of a symbol's parts
    for level in range(LONG_LEVELS + 1):
        for least in LONG_WINDOWS:
            new = np.flatnonzero((size >= least * width) & (largest < least * width))
            starts.append(begin[new])
            sizes.append(size[new])
        if level == LONG_LEVELS or len(begin) <= 1:
            break
        right = is_right(name, LEVELS + level)
        after = np.zeros(len(name), bool)  # joined with the next symbol
        after[:-1] = ~right[:-1] & right[1:] & ~first[1:]
        keep = np.ones(len(name), bool)
        keep[1:] = ~after[:-1]
        both = np.flatnonzero(after)
        name, largest = name.copy(), size.copy()
        largest[both] = np.maximum(size[both], size[both + 1])
        name[both] = pair_name(name[both], name[both + 1], LEVELS + level)
        name, largest, begin, first = name[keep], largest[keep], begin[keep], first[keep]
        size = np.diff(np.append(begin, n))
    return np.concatenate(starts), np.concatenate(sizes)


def least_of_ranges(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi], none empty, from minima of runs of 1, 2, 4, ... values."""
    length = hi - lo
    out = np.empty(len(lo), values.dtype)
    step, tables = 1, values
    while True:
        rows = np.flatnonzero((length >= step) & (length < 2 * step))
        out[rows] = np.minimum(tables[lo[rows]], tables[hi[rows] - step])
        if not len(length) or 2 * step > length.max():
            return out
        tables = np.concatenate([np.minimum(tables[:-step], tables[step:]), tables[-step:]])
        step *= 2


def window_anchors(codes: np.ndarray, offsets: np.ndarray, width: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Start (word number) and anchor of every window of width words that lies in one document. offsets: of the documents."""
    n, counts = len(codes), np.diff(offsets)
    starts = np.flatnonzero(np.arange(n) + width <= np.repeat(offsets[1:], counts))
    chosen = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return starts, chosen
    first = np.zeros(n, bool)
    first[offsets[:-1][counts > 0]] = True
    sums = range_sums(codes)
    stages = [named_runs(codes, first)]
    for level in range(levels):
        stages.append(paired(*stages[-1], salt=level))
    left = np.arange(len(starts))  # windows without an anchor so far
    for name, lo, hi, _ in reversed(stages):
        order = mix(name ^ fold_range(sums, np.maximum(lo, 0), np.minimum(hi, n)))
        # Contexts are in order from both sides: those within a window are a range of symbols.
        begun = np.cumsum(np.bincount(np.maximum(lo + 1, 0), minlength=n + 2))  # begun[p]: symbols with lo < p
        ended = np.cumsum(np.bincount(np.clip(hi, 0, n + 1), minlength=n + 2))  # ended[p]: symbols with hi <= p
        i, j = begun[starts[left]], ended[starts[left] + width]
        good = j > i
        chosen[left[good]] = least_of_ranges(order, i[good], j[good])
        left = left[~good]
        if not len(left):
            return starts, chosen
    chosen[left] = windows(codes, width)[starts[left]]
    return starts, chosen


def anchor_runs(codes: np.ndarray, offsets: np.ndarray, width: int, skipped: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, anchor, first window (word number) and number of windows of every run of neighbouring windows of one anchor.

    A run longer than width, as equal words in a row give, is cut. skipped: word numbers whose windows are left out.
    """
    starts, anchors = window_anchors(codes, offsets, width)
    if skipped is not None:
        left = ~skipped[starts]
        starts, anchors = starts[left], anchors[left]
    owner = np.searchsorted(offsets, starts, "right") - 1
    head = np.ones(len(starts), bool)
    head[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(starts)))
    pieces = -(-size // width)
    at = np.repeat(at, pieces)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = at + nth * width
    return owner[at], anchors[at], starts[begin] if len(starts) else begin, np.minimum(np.repeat(size, pieces) - nth * width, width)
