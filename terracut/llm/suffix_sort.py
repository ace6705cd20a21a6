"""Deep-shallow sorting of suffixes, for all groups of an array at once in numpy.

Shallow: multikey quicksort. A character has CHAR bytes. In each round every open group is parted by the character of its
middle suffix into less, equal and greater; the equal part goes on to the next character, down to SHALLOW of them. Groups
of up to SMALL suffixes are put in order directly, as quicksorts do; all groups' keys of a round are sorted in one call.

Deep: suffixes that agree in the shallow characters are ordered by blind tries, one for each group of up to BLIND of
them; the quicksort goes on with larger ones, until they are so small or agree in all bytes. A trie's inner nodes have
only the number of the bit at which their leaves part. A suffix goes down by its own bits without comparing any bytes, is
then compared once with the leaf that it reaches, and enters where their first different bit says. All tries of the array
take a suffix each at a time. A suffix that agrees with its leaf in all `width` bytes is equal to it.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a character: with the number of its group it makes one 64-bit key.
CHAR = 5
SHALLOW = 3
SMALL = 1024
BLIND = 32


def big_words(data: np.ndarray, width: int) -> np.ndarray:
    """The 8 bytes from each place on as big-endian numbers, whose order is that of the bytes. Zeros follow the data."""
    x = np.concatenate([data, np.zeros(width + 8, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        x = (x[:-shift] << np.uint64(8 * shift)) | x[shift:]
    return x


def character(words: np.ndarray, start: np.ndarray, depth: np.ndarray, width: int) -> np.ndarray:
    """The CHAR bytes that follow depth characters; bytes from `width` on do not count."""
    beyond = np.maximum(CHAR * (depth + 1) - width, 0)
    return words[start + CHAR * depth] >> (64 - 8 * CHAR + 8 * beyond).astype(np.uint64)


def multikey(words: np.ndarray, start: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order of group and SHALLOW characters, the number of the group of agreeing ones that each is in, and in
    how many characters they agree: more where a group is large."""
    order = np.argsort(group, kind="stable")
    split = np.ones(len(order), bool)
    split[1:] = group[order][1:] != group[order][:-1]
    depth, most = np.zeros(len(order), np.int64), -(-width // CHAR)
    at, own, deep = np.arange(len(order)), np.cumsum(split) - 1, depth.copy()
    while len(at):
        size = np.bincount(own)
        goes_on = (size[own] > 1) & ((deep < SHALLOW) | ((size[own] > BLIND) & (deep < most)))
        at, own, deep = at[goes_on], own[goes_on], deep[goes_on]
        lead = np.ones(len(at), bool)
        lead[1:] = own[1:] != own[:-1]
        own = np.cumsum(lead) - 1
        mine, size = order[at], np.bincount(own)
        key = character(words, start[mine], deep, width)
        large = size[own] > SMALL
        if large.any():
            # The pivot of a large group is the character in its middle.
            middle = (np.cumsum(size) - size + size // 2)[own[large]]
            pivot = key[middle]
            key[large] = np.where(key[large] < pivot, 0, np.where(key[large] > pivot, 2, 1))
        both = (own.astype(np.uint64) << np.uint64(8 * CHAR)) | key
        by = np.argsort(both)
        order[at], both = mine[by], both[by]
        deep = deep[by] + (~large | (key[by] == 1))
        depth[at] = deep
        lead[1:] = both[1:] != both[:-1]
        split[at[lead]] = True
        own = np.cumsum(lead) - 1
    return order, np.cumsum(split) - 1, depth


def first_difference(words: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Number of the first different bit among the first `width` bytes from a and b; 8 * width where there is none."""
    out = np.full(len(a), 8 * width, np.int64)
    left = np.arange(len(a))
    for k in range(CHAR * SHALLOW, width, 8):
        diff = words[a[left] + k] ^ words[b[left] + k]
        if k + 8 > width:
            diff &= ~np.uint64((1 << (8 * (k + 8 - width))) - 1)
        found = diff != 0
        if found.any():
            # Leading zeros, exactly: by the high half first.
            d = diff[found]
            high = d >> np.uint64(32)
            half = np.where(high > 0, high, d & np.uint64(0xFFFFFFFF)).astype(np.float64)
            out[left[found]] = 8 * k + np.where(high > 0, 0, 32) + 31 - (np.frexp(half)[1] - 1)
            left = left[~found]
        if not len(left):
            break
    return out


def blind_tries(words: np.ndarray, start: np.ndarray, order: np.ndarray, parts: np.ndarray, width: int) -> np.ndarray:
    """For each place of order, the place of the suffix that stands for its class (equal in all bytes) in its group."""
    n = len(order)
    stands = np.arange(n)
    size = np.bincount(parts) if n else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    places = start[order]
    # Node k < n is the leaf of place k; node n + k is the inner node that came with the suffix of place k.
    bit = np.zeros(2 * n, np.int64)
    child = np.zeros((2 * n, 2), np.int64)
    root = first.copy()
    active = np.flatnonzero(size > 1)
    active = active[np.argsort(-size[active], kind="stable")]
    step = 1
    while True:
        active = active[: np.searchsorted(-size[active], -step, "left")]
        if not len(active):
            return stands
        new = first[active] + step
        at = places[new]

        def turn(node: np.ndarray, at: np.ndarray) -> np.ndarray:
            b = bit[node]
            return ((words[at + (b >> 6 << 3)] >> (63 - (b & 63)).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

        node = root[active].copy()
        going = np.flatnonzero(node >= n)
        while len(going):
            node[going] = child[node[going], turn(node[going], at[going])]
            going = going[node[going] >= n]
        differs = first_difference(words, at, places[node], width)
        equal = differs == 8 * width
        stands[new[equal]] = stands[node[equal]]
        enter = np.flatnonzero(~equal)
        if len(enter):
            new, at, differs, trie = new[enter], at[enter], differs[enter], active[enter]
            parent, side = np.full(len(enter), -1), np.zeros(len(enter), np.int64)
            node = root[trie].copy()
            going = np.flatnonzero((node >= n) & (bit[node] < differs))
            while len(going):
                parent[going] = node[going]
                side[going] = turn(node[going], at[going])
                node[going] = child[node[going], side[going]]
                going = going[(node[going] >= n) & (bit[node[going]] < differs[going])]
            inner = n + new
            bit[inner] = differs
            own = turn(inner, at)
            child[inner, own] = new
            child[inner, 1 - own] = node
            top = parent < 0
            root[trie[top]] = inner[top]
            child[parent[~top], side[~top]] = inner[~top]
        step += 1


def classes(data: np.ndarray, start: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """For each suffix, a number that it shares with just those of its group that agree with it in the first `width` bytes."""
    words = big_words(data, width)
    order, parts, depth = multikey(words, start, group, width)
    out = np.arange(len(order))
    size = np.bincount(parts, minlength=1)
    first = np.cumsum(size) - size
    # Groups that agree in all bytes are classes; suffixes that stand alone need no trie either.
    agree = CHAR * depth >= width
    out[order[agree]] = order[first[parts[agree]]]
    left = ~agree & (size[parts] > 1)
    order, parts = order[left], parts[left]
    out[order] = order[blind_tries(words, start, order, np.unique(parts, return_inverse=True)[1], width)]
    return out
