"""Exact dedup, near-dedup and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terracut.llm import components, exact_dedup, minhash, recompress, substrings
from terracut.llm.components import smallest_reachable
from terracut.llm.words import lower_ascii, split_words, windows

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def test_exact_dedup(spark, docs, texts):
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups: dict[str, list] = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append(i)
    want = Counter((i, least(groups[norm(t)]), len(groups[norm(t)]), i == least(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in texts)
    for runs, fan_in in ((8, 2), (1, 2), (7, 3), (64, 8)):
        got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, runs=runs, fan_in=fan_in).collect())
        assert got == want


def test_exact_dedup_merges_sorted_runs(docs):
    """Each level is a sorted aggregate over rows in order of the digest; nothing is hashed, and no level sorts before it sends."""
    plan = exact_dedup.exact_dedup(docs, runs=8, fan_in=2)._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" +-:*()0123456789") for line in plan.split("\n")]
    # Only the keys of the runs, on the way back, are told apart by hashing.
    assert all("functions=[]" in line for line in lines if line.startswith("HashAggregate"))
    top = lines[next(i for i, line in enumerate(lines) if line.startswith("SortAggregate")) :]
    kinds = [line.split("(")[0].split(" ")[0] for line in top if line.startswith(("SortAggregate", "Sort ", "Exchange"))]
    # From the last merge down to the base: merge, sort of what came in, exchange, first half.
    assert kinds[:16] == ["SortAggregate", "Sort", "Exchange", "SortAggregate"] * 4


def test_exact_dedup_refuses_no_merge(docs):
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs, fan_in=1)


def sets(texts, k):
    out = []
    for _, t in texts:
        w = (t or "").encode().translate(LOWER).split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def near_groups(texts, k):
    s, parent = sets(texts, k), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    members: dict[int, list] = {}
    for i in range(len(s)):
        members.setdefault(find(i), []).append(texts[i][0])
    return [(texts[i][0], len(s[i]), least(members[find(i)]) if s[i] else texts[i][0]) for i in range(len(s))]


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(spark, docs, texts, k):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(docs, k=k).collect())
    assert got == Counter((i, n, c, i == c) for i, n, c in near_groups(texts, k))


def test_near_dedup_in_blocks(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(minhash, "DIRECT", 0)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 1)
    got = Counter((r.doc_id, r.component_id) for r in minhash.near_dedup(docs, k=4).collect())
    assert got == Counter((i, c) for i, _, c in near_groups(texts, 4))


def test_near_dedup_one_id_two_texts(spark, texts):
    """Each text of an id keeps its own links, though both are the smallest of their class."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "vw")
    rows = [(7, a), (7, b), (9, a + " x"), (11, b + " y"), (3, b), (3, a), (12, "v1 v2 v3"), (12, "other words"), (13, "v1 v2 v3")] + [(7, a)] * 300 + [(None, a), (None, b), (None, "only null has this")]
    for part in (rows, rows[:4], rows[6:]):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_dedup(spark.createDataFrame(part, "doc_id long, text string"), k=4).collect())
        assert got == Counter(near_groups(part, 4))


def test_drop_near_judges_rows(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(3, a, "x"), (None, a, "x"), (None, "alone and null", "y"), (5, a + " z", "x"), (6, None, "n"), (6, None, "n"), (8, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string").withColumns({c: F.lit(c) for c in ("row", "id", "hash", "text_hash", "kept", "n")})
    left = minhash.drop_near(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(3, a), (None, "alone and null"), (6, None), (6, None), (8, "")])


@pytest.mark.parametrize("n", [12, 40])
def test_near_dedup_when_the_stars_link_nothing(spark, n):
    """A template's documents stand just below the threshold; the one true pair never has a bucket's smallest id."""
    rng = random.Random(11)
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    template = words(200)
    rows = [(i, f"{template} {words(40)}") for i in range(n)]
    rows[n - 1] = (n - 1, rows[n - 2][1] + " ran tel")
    want = near_groups(rows, 5)
    assert [c for _, _, c in want] == [*range(n - 1), n - 2]
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bands=6, rows=1)
    assert Counter((r.doc_id, r.component_id) for r in got.collect()) == Counter((i, c) for i, _, c in want)


def test_block_intersections():
    rng = np.random.default_rng(1)
    a, b = [np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(7)], [np.unique(rng.integers(0, 60, rng.integers(1, 30))) for _ in range(5)]
    flat = lambda s: (np.concatenate([[0], np.cumsum([len(x) for x in s])]), np.concatenate(s))
    got = minhash.common_counts(*flat(a), *flat(b), chunk=16)
    assert (got == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(2)
    sampler = minhash.Sampler(36, 5)
    errors = []
    for _ in range(20):
        common, own = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 50), dtype=np.uint64)
        x, y = (sampler.sketch(sampler.samples(np.concatenate([common, o]))) for o in own)
        differing = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        errors.append(float(minhash.sketch_similarity(differing, 180)) - 0.9)
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.12


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in smallest_reachable(links).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


@pytest.mark.parametrize(("few", "tables"), [(1 << 18, 1), (0, 3)])
def test_few_links_take_no_rounds(spark, monkeypatch, few, tables):
    """Few links are one stored table and no more; by rounds the result is the same."""
    written = []
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or df.localCheckpoint())
    rng = np.random.default_rng(4)
    path = rng.permutation(40).tolist()
    links = spark.createDataFrame([*zip(path, path[1:], strict=False), (100, 101), (101, 100), (101, 102), (103, 103), (-5, 102)], "a long, b long")
    got = {r.node: r.component for r in smallest_reachable(links).collect()}
    assert got == {**dict.fromkeys(range(40), 0), **dict.fromkeys([100, 101, 102, -5], -5)}
    assert len(written) == 1 if tables == 1 else len(written) >= tables


def without_repeats(texts, width):
    first: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in texts]
    for i, w in split:
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s : s + width])] < i:
                keep[s : s + width] = [False] * width
        out.append((i, len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return Counter(out)


@pytest.mark.parametrize("width", [13, 5])
def test_substring_dedup(spark, docs, texts, width):
    got = Counter(tuple(r) for r in substrings.drop_repeats(docs, width=width).collect())
    assert got == without_repeats(texts, width)


def test_substring_dedup_one_id_two_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, f"{b} x"), (3, b)]
    got = Counter(tuple(r) for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == without_repeats(rows, 13)


def test_substring_dedup_of_repeated_rows(spark):
    """Thousands of rows of one id, of one text or of several, take time in proportion to their number."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    text = say(200)
    texts = [f"{say(20)} {text[: 40 * (i % 30)]} {say(5)}" for i in range(400)]
    rows = [(1, text)] + [(2, text)] * 8000 + [(3, t) for t in texts]
    got = Counter(tuple(r) for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == without_repeats(rows, 13)


def test_long_repeats_are_found_by_long_symbols(spark, texts):
    """Every equal passage is cut into equal long symbols but for its margins; symbols of one digest have the same words."""
    rng = random.Random(13)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(400))
    rows = [(i, f"{' '.join(f'x{rng.randrange(10**6)}' for _ in range(rng.randint(0, 60)))} {passage}  \t{'tail ' * i}") for i in range(12)] + texts
    docs = spark.createDataFrame(rows, "id long, t string").where("id IS NOT NULL").withColumn("hash", F.xxhash64("t"))
    split, words_of, covered = {}, {}, Counter()
    for i, t in rows:
        split.setdefault(i, []).append((t or "").encode().split())
    symbols = substrings.symbols_of(docs, 13).collect()
    for r in symbols:
        assert r.n >= 26
        cut = {tuple(w[r.start : r.start + r.n]) for w in split[r.id]}
        words_of.setdefault((r.d1, r.d2), cut)
        assert words_of[r.d1, r.d2] & cut
    ids = {}
    for r in symbols:
        ids.setdefault((r.d1, r.d2), set()).add(r.id)
    for i in range(1, 12):
        spots = set()
        for r in symbols:
            if r.id == i and min(ids[r.d1, r.d2]) < i:
                spots |= set(range(r.start, r.start + r.n))
        covered[i] = len(spots)
    assert min(covered.values()) > 200, covered


def test_equal_windows_have_equal_anchors(texts):
    anchors: dict[int, int] = {}
    many = pa.array([t for _, t in texts] * 2)
    total = runs = 0
    for b in split_words(many, lower_ascii, limit=1 << 12):
        starts, chosen = recompress.window_anchors(b.codes, b.offsets, 13)
        for w, a in zip(windows(b.codes, 13)[starts].tolist(), chosen.tolist(), strict=True):
            assert anchors.setdefault(w, a) == a
        _, _, _, n = recompress.anchor_runs(b.codes, b.offsets, 13)
        total, runs = total + int(n.sum()), runs + len(n)
    assert total == 2 * sum(max(0, len((t or "").encode().split()) - 12) for _, t in texts)
    assert runs < total / 2


def test_empty_tables(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert minhash.near_dedup(no_docs).count() == 0
    assert substrings.drop_repeats(no_docs).count() == 0


def test_no_links(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_dedup(rows).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert substrings.drop_repeats(rows).agg(F.sum("n_removed")).first()[0] == 0
