from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracut.llm import codes, repair, suffixes
from terracut.llm.suffix_sort import BLIND, CHAR, SHALLOW, big_words, blind_tries, classes, multikey


def removed_bytes(rows, width):
    """By the rule, window by window."""
    firsts = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for s in range(len(raw) - width + 1):
                key = raw[s : s + width]
                firsts[key] = min(firsts.get(key, (i, s)), (i, s))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        if i is not None:
            for s in range(len(raw) - width + 1):
                if firsts[raw[s : s + width]] < (i, s):
                    gone[s : s + width] = [True] * width
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), sum(1 for k, _ in itertools.groupby(gone) if k), kept))
    return sorted(out, key=str)


def as_rows(left, id_col="doc_id"):
    return sorted(((r[id_col], r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in left.collect()), key=str)


@pytest.mark.parametrize("width,hot", [(100, 1000), (30, 1000), (30, 2), (16, 3)])
def test_suffixes_equal_brute_force(docs, texts, width, hot, monkeypatch):
    """All cases of the fixture; with few runs an anchor is hot, and goes by windows."""
    monkeypatch.setattr(suffixes, "HOT_RUNS", hot)
    assert as_rows(suffixes.drop_repeats(docs, width=width)) == removed_bytes(texts, width)


def test_suffixes_of_one_text_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    rng = random.Random(3)
    line = "".join(rng.choice("abcdé ") for _ in range(150))
    rows = [(1, "a" * 900), (2, "ab" * 300 + line), (3, line + "x" + line), (4, "a" * 99), (5, "a" * 100), (6, "é" * 120), (3, line[:140]), (-1, line[20:]), (None, line), (9, "")]
    left = suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(left) == removed_bytes(rows, 100)


def test_suffixes_empty_and_types(spark, no_docs):
    assert suffixes.drop_repeats(no_docs).collect() == []
    with pytest.raises(TypeError):
        suffixes.drop_repeats(no_docs.withColumn("doc_id", F.lit("x")))


@pytest.mark.parametrize("letters", [1, 2, 3, 250])
def test_sort_orders_and_classes(letters):
    rng = np.random.default_rng(letters)
    data = rng.integers(0, letters, 700).astype(np.uint8)
    data = np.concatenate([data, data[100:400]])
    start = rng.permutation(len(data) - 40)
    group = rng.integers(0, 3, len(start))
    order, parts, depth = multikey(big_words(data, 40), start, group, 40)
    shallow = [(group[i], data[start[i] : start[i] + CHAR * SHALLOW].tobytes()) for i in order]
    assert shallow == sorted(shallow)
    for p in np.unique(parts):
        mine = np.flatnonzero(parts == p)
        agree = {(group[i], data[start[i] : start[i] + CHAR * d].tobytes()) for i, d in zip(order[mine], depth[mine], strict=True)}
        assert len(mine) == 1 or (len(agree) == 1 and (len(mine) <= BLIND or CHAR * depth[mine[0]] >= 40))
    assert len(blind_tries(big_words(data, 40), start, order, parts, 40)) == len(order)
    found = classes(data, start, group, 40)
    full = [(g, data[s : s + 40].tobytes()) for s, g in zip(start.tolist(), group.tolist(), strict=True)]
    assert len(set(found.tolist())) == len(set(full)) == len(set(zip(found.tolist(), full, strict=True)))


def plain_codes(vectors):
    """vec_id -> (code, error) and codebooks, entry by entry."""
    width = -(-max((len(v) for _, v in vectors), default=0) // 16) * 16
    whole = [(i, [math.floor(256 * x) for x in v] + [0] * (width - len(v))) for i, v in vectors]
    step = width // 16
    first = sorted(whole, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:64]
    books = [[v[p * step : (p + 1) * step] for _, v in first] for p in range(16)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        for p in range(16):
            of = {}
            for _, v in whole:
                part = v[p * step : (p + 1) * step]
                of.setdefault(near(p, part)[1], []).append(part)
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    out = []
    for i, v in whole:
        found = [near(p, v[p * step : (p + 1) * step]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 40, 200])
def test_codes_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i if i % 17 else None, [rng.choice([rng.uniform(-1, 1), 0.25, -0.25]) for _ in range(32 if i % 5 else 30)], i % 3 if i % 4 else None) for i in range(n)]
    rows += rows[:3]
    bad = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] + [0.0] * 31, 1)]
    df = spark.createDataFrame([(*r, "x", 5, "y") for r in rows + bad], "vec_id long, embedding array<float>, label int, code string, v int, row string").repartition(4)
    as_float = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v, _ in rows]
    want, book = plain_codes(as_float) if rows else ([], None)
    by_label = {}
    for (_, _, label), (_, _, error) in zip(rows, want, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    want = [(i, c, e, by_label[label], book) for (i, c, e), (_, _, label) in zip(want, rows, strict=True)]
    got = [tuple(r) for r in codes.compress(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_partial_distances_and_ties():
    rng = np.random.default_rng(0)
    for high in (2, 50):
        book, parts = rng.integers(0, high, (64, 5)), rng.integers(0, high, (300, 5))
        index, error = codes.nearest(parts, book, codes.by_variance(book))
        full = ((parts[:, None] - book[None]) ** 2).sum(2)
        assert (index == full.argmin(1)).all() and (error == full.min(1)).all()
    assert codes.by_variance(np.array([[0, 5, 1], [0, 1, 5]])).tolist() == [1, 2, 0]


def test_encode_keeps_columns(spark):
    df = spark.createDataFrame([(1, [0.5] * 16, "a", 7)], "vec_id int, embedding array<double>, row string, error int")
    out = codes.encode(df, codes.train(df))
    assert out.columns == ["vec_id", "embedding", "row", "code", "error"]
    assert out.collect()[0]["error"] == 0
    with pytest.raises(ValueError, match="beyond"):
        codes.integers(spark.createDataFrame([([1e9],)], "v array<double>").toArrow()["v"], 16)


def plain_repair(turns):
    """Least (cost, audit) with the repaired turns, by trying all edits in order of cost."""
    best = {(0, "start"): (0, "", ())}
    seen, faults = set(), []
    for role, text in turns:
        filled = [c for c in text if c not in " \t\n\v\f\r"]
        faults.append("blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else None)
        seen.add((role, text))
    after = {"start": "user", "s": "user", "user": "assistant", "assistant": "user"}
    heap, done = [(0, "", 0, "start", ())], {}
    import heapq

    best = None
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if done.setdefault((i, state), (cost, audit)) < (cost, audit):
            continue
        if i == len(turns) and state in ("start", "assistant"):
            best = min(best or (cost, audit, out), (cost, audit, out))
        heapq.heappush(heap, (cost + 3, audit + "I", i, after[state], (*out, (after[state], ""))))
        if i < len(turns):
            role, text = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, after[state], (*out, (after[state], text))))
                if role[:1] == "s" and state == "start" or role[:1] == after[state][0]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, "s" if role[:1] == "s" else after[state], (*out, (role, text))))
    return faults, best


def expected_repairs(rows, damage):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        if deal == 0:
            continue
        text = "" if deal == 1 else "".join(c for c in text if c not in ".!?") if deal == 2 else text
        mine += [(turn, "user" if deal == 4 else role, text)] * (2 if deal == 3 else 1)
    for conv, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, (cost, audit, left) = plain_repair([x[1:] for x in turns])
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("damage", [True, False])
def test_repair_equals_brute_force(spark, damage):
    rng = random.Random(11)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn + rng.choice([0, 0, 0, 1]) if rng.random() > 0.05 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s2"]), rng.choice(["Yes.", "No!", "what", "so?  ", " \n", "", None, "Good day. And", "é."])))
    rows += rows[:40] + [(None, 1, "user", "Hm."), (None, None, "assistant", "Oh.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, conv string, code int").repartition(4)
    got = sorted((tuple(r) for r in repair.repair_conversations(df, damage=damage).collect()), key=str)
    assert got == expected_repairs(rows, damage)


def test_long_and_empty_conversations(spark):
    rows = [(5, t, ["user", "assistant"][t % 2], f"{t}." * 50) for t in range(3000) if t != 1500] + [(6, 0, "user", "x." * 100_000), (6, 1, "assistant", "Fine.")]
    got = sorted(tuple(r) for r in repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert [r[:7] for r in got] == [(5, 1, 0, 0, 0, 1, 3), (6, 0, 0, 0, 0, 0, 0)]
    assert got[0][7] == "K" * 1500 + "I" + "K" * 1499
    assert repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), damage=True).collect() == []
    lost = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    only = repair.repair_conversations(spark.createDataFrame([(1, lost, "user", "Hi.")], "conv_id long, turn long, role string, text string"), damage=True).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    with pytest.raises(TypeError):
        repair.repair_conversations(spark.createDataFrame([(1.5, 1, "user", "Hi.")], "conv_id double, turn long, role string, text string"))
