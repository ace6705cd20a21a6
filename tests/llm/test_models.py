"""The class language model and the quality classifier: formulas, normalisation, held-out gains."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terracut.llm import brown, quality

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def test_base_scores(docs, texts):
    held = lambda i: i is not None and i % 5 == 0
    got = brown.class_lm(docs, F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))).collect()
    counts, n = Counter(), 0
    for i, t in texts:
        if not held(i):
            counts.update(words(t))
            n += 1
    total, types = sum(counts.values()) + n, len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (total + 0.1 * (types + 1)))
    want = Counter((i, held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in words(t)) + 1, total, round(sum(log(counts[w]) for w in words(t)) + log(n), 6)) for i, t in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def code_of(word: bytes) -> int:
    return int(next(brown.coded(b) for b in brown.split_words(pa.array([word.decode()]), brown.lower_ascii))[0])


@pytest.fixture(scope="module")
def little(spark, texts):
    """A small corpus's model, its words' classes and its texts' sequences, with most words looked up by the join."""
    keep = brown.UNIT_SHARE, brown.LOCAL_SHARE
    brown.UNIT_SHARE, brown.LOCAL_SHARE = 0.02, 0.005
    rows = [(i, t) for i, t in texts if len(t or "") < 5000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    model, table = brown.train(docs.where(~held).select("text"), n_classes=8)
    flagged = docs.select(F.col("doc_id").alias("who"), (~held).alias("learnt"), F.col("text").alias("t"))
    model.transition = brown.transitions(brown.class_sequences(flagged, model, table).cache(), model)
    scores = brown.class_lm(docs, held).collect()
    default, default_table = brown.train(docs.where(~held).select("text"))
    default.transition = brown.transitions(brown.class_sequences(flagged, default, default_table), default)
    tables = table.collect(), default_table.collect()
    brown.UNIT_SHARE, brown.LOCAL_SHARE = keep
    return rows, model, tables[0], default, tables[1], scores


def class_of(model, table):
    """The class of any word, and the training count of its code, in plain Python."""
    units = {int(c): k for k, c in enumerate(model.units.words)}
    known = {r.code % 2**64: r for r in table}

    def find(word):
        code = code_of(word)
        if code in units:
            return int(model.classes[units[code]]), known[code].n
        if code in known:
            return known[code].own, known[code].n
        return int(model.classes[len(units) + code % brown.ENDINGS]), 0

    return find


def test_probabilities_add_up(little):
    _, model, table, *_ = little
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    codes, n = np.array([r.code for r in table]).view(np.uint64), np.array([r.n for r in table])
    unit = model.units.of(codes)
    classes = np.array([model.classes[u] if r.own is None else r.own for u, r in zip(unit, table, strict=True)])
    assert all((r.own is None) == (u < len(model.units.words)) for u, r in zip(unit, table, strict=True))
    shares = np.bincount(classes, weights=10 ** model.emission(codes, n, classes), minlength=8)
    endings = np.arange(brown.ENDINGS).astype(np.uint64)
    of = model.ending_class(endings)
    shares += np.bincount(of, weights=10 ** model.emission(endings, np.zeros(brown.ENDINGS), of), minlength=8)
    shares[model.end_class] += 10 ** model.end_emission()
    assert np.allclose(shares, 1)


def test_scores_by_hand(little):
    """Transitions counted, and every text scored, word by word in plain Python."""
    rows, _, _, model, table, scores = little
    find, follows = class_of(model, table), Counter()
    for i, t in rows:
        if i is None or i % 5:
            path = [model.end_class, *(find(w)[0] for w in words(t)), model.end_class]
            follows.update(zip(path, path[1:], strict=False))
    n = len(model.mass)
    log = lambda a, b: math.log10((follows[a, b] + 0.5) / (sum(follows[a, c] for c in range(n)) + 0.5 * n))
    assert all(abs(log(a, b) - model.transition[a, b]) < 1e-9 for a in range(n) for b in range(n))
    want = Counter()
    for i, t in rows:
        before, total = model.end_class, 0.0
        for w in words(t):
            c, k = find(w)
            total += log(before, c) + math.log10((k or model.unseen[code_of(w) % brown.ENDINGS]) / model.mass[c])
            before = c
        total += log(before, model.end_class) + math.log10((model.texts + 0.1) / model.mass[model.end_class])
        want[i, round(total, 5)] += 1
    assert Counter((r.doc_id, round(r.score, 5)) for r in scores) == want


def test_every_training_word_chooses_its_class(little):
    """Of all classes, the one in which the word's neighbours raise the likelihood most."""
    rows, model, table, *_ = little
    units = {int(c): k for k, c in enumerate(model.units.words)}
    unit = lambda w: units.get(code_of(w), len(units) + code_of(w) % brown.ENDINGS)
    follows, near = np.zeros((8, 8)), {}
    for i, t in rows:
        if i is None or i % 5:
            ws = words(t)
            path = [model.units.end, *(unit(w) for w in ws), model.units.end]
            cls = [int(model.classes[u]) for u in path]
            for a, b in zip(cls, cls[1:], strict=False):
                follows[a, b] += 1
            for k, w in enumerate(ws):
                if unit(w) >= len(units):
                    near.setdefault(w, []).append((cls[k], cls[k + 2]))
    mass = follows.sum(axis=1)
    own = {r.code % 2**64: r.own for r in table}
    assert len(near) > 20
    for w, around in near.items():
        gain = [sum(math.log(follows[a, c] + 0.5) + math.log(follows[c, b] + 0.5) - 2 * math.log(mass[c] + 1) for a, b in around) for c in range(8)]
        assert gain[own[code_of(w)]] >= max(gain) - 1e-6


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    true = np.repeat(np.arange(4), 10)
    counts = rng.poisson(np.where((true[:, None] + 1) % 4 == true[None, :], 40, 1)).astype(float)
    n = 4
    classes = np.arange(40) % n
    table = lambda c: np.array([[counts[np.ix_(c == a, c == b)].sum() for b in range(n)] for a in range(n)])

    def likelihood(c):
        t = table(c)
        plog = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return plog(t) - plog(t.sum(axis=0)) - plog(t.sum(axis=1))

    seen = [likelihood(classes)]
    for _ in range(5):
        left = np.stack([counts.T[:, classes == c].sum(axis=1) for c in range(n)], axis=1)
        right = np.stack([counts[:, classes == c].sum(axis=1) for c in range(n)], axis=1)
        classes = brown.better_classes(left, right, right.sum(axis=1), classes, n)
        seen.append(likelihood(classes))
    assert seen[-1] > seen[0] and seen[-1] == max(seen)


def test_classes_beat_unigrams_on_held_out_texts(spark):
    rng = random.Random(1)
    groups = [[f"{a}{i}" for i in range(12)] for a in ("der", "run", "bla", "ist")]
    sentence = lambda: " ".join(rng.choice(groups[k % 4]) for k in range(40))
    rows = spark.createDataFrame([(i, sentence()) for i in range(400)], "doc_id long, text string")
    out = brown.class_lm(rows, F.col("doc_id") % 10 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.75 * out[1]


def test_lm_without_training(docs, no_docs):
    got = brown.class_lm(docs, F.lit(True)).collect()
    assert {r.n_known for r in got} == {0} and {r.train_tokens for r in got} == {0}
    assert brown.class_lm(no_docs, F.lit(False)).count() == 0


def rated(n, seed):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(200)]
    texts, grades = [], []
    for _ in range(n):
        g = rng.choice([0, 1, 2, 2, 2])
        t = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        for _ in range({0: 6, 1: 2, 2: 0}[g]):
            t.insert(rng.randrange(len(t)), rng.choice(["spam!", "buy", "cheap"] if g == 0 else ["nastyone", "nastytwo", f"nasty{rng.randint(0, 99)}"]))
        texts.append(" ".join(t))
        grades.append(g)
    return texts, np.array(grades)


def test_ordinal_fit():
    texts, grades = rated(1500, 0)
    model = quality.fit(quality.features(pa.array(texts)), grades, 3)
    assert (np.diff(model.thresholds) > 0).all()
    texts, grades = rated(600, 1)
    expected, tails = model.score(quality.features(pa.array(texts)))
    assert (tails[:, 0] >= tails[:, 1]).all() and np.allclose(tails.sum(axis=1), expected)
    kept = tails[:, 1] >= quality.LEAST_TAIL
    assert kept[grades == 2].mean() > 0.97 and kept[grades < 2].mean() < 0.05


def test_quality_query_functions(spark, docs, texts, no_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(30)] + [(None, 1, True), (3, None, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    model = quality.train(docs, quality.graded(labels), "doc_id", "text", "grade", 3)
    got = quality.score(docs, model, "doc_id", "text", 2, 0.5).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts)
    kept = quality.keep_good(docs, model, "text", 2, 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.score(no_docs, model, "doc_id", "text", 2, 0.5).count() == 0
    twice = labels.unionByName(spark.createDataFrame([(i, 0, 0) for i in range(0, 30, 4)], labels.schema))
    a, b = (quality.train(docs, quality.graded(t), "doc_id", "text", "grade", 3) for t in (twice, twice.repartition(7)))
    assert (a.words == b.words).all() and (a.thresholds == b.thresholds).all()
    unfitted = quality.train(no_docs, quality.graded(labels), "doc_id", "text", "grade", 3)
    assert quality.score(docs, unfitted, "doc_id", "text", 2, 0.5).count() == len(texts)


def test_fit_climbs_the_likelihood_and_scores_are_its_probabilities():
    """Gradients by differences of a likelihood in plain Python vanish at the fit, and scores are the cumulative logits."""
    texts, grades = rated(400, 3)
    x = quality.features(pa.array(texts), 12)
    model = quality.fit(x, grades, 3, 12, steps=1500, sparse=0.0)
    sigmoid = lambda v: 1 / (1 + math.exp(-max(-500, min(500, v))))

    def tails(words, shapes, thresholds, i):
        z = sum(float(words[j]) for j in x.words[x.offsets[i] : x.offsets[i + 1]])
        z += sum((x.shapes[i, j] - model.centre[j]) / model.spread[j] * shapes[j] for j in range(quality.SHAPES))
        return [1 - sigmoid(t - z) for t in thresholds]

    def likelihood(words, shapes, thresholds):
        total = 0.0
        for i, g in enumerate(grades):
            p = [1.0, *tails(words, shapes, thresholds, i), 0.0]
            total += math.log(max(p[g] - p[g + 1], 1e-12))
        return total / len(grades)

    expected, got = model.score(x)
    for i in range(0, 400, 40):
        want = tails(model.words, model.shapes, model.thresholds, i)
        assert np.allclose(got[i], want, atol=1e-5) and abs(expected[i] - sum(want)) < 1e-5
    best = likelihood(model.words, model.shapes, model.thresholds)
    start = likelihood(np.zeros_like(model.words), np.zeros_like(model.shapes), model.thresholds)
    assert best > start + 0.3
    used = np.flatnonzero(model.words)[::97]
    for j in used[:8]:
        for step in (-0.5, 0.5):
            moved = model.words.copy()
            moved[j] += step
            assert likelihood(moved, model.shapes, model.thresholds) < best + 2e-3


@pytest.mark.parametrize("bits", [10, 20])
def test_features_do_not_depend_on_batches(texts, bits):
    many = pa.array([t for _, t in texts])
    whole, parts = quality.features(many, bits), [quality.features(many.slice(i, 1), bits) for i in range(len(many))]
    assert (whole.words == np.concatenate([p.words for p in parts])).all()
    assert np.allclose(whole.shapes, np.concatenate([p.shapes for p in parts]))
