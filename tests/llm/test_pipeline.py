"""The corpus pipeline on a small corpus: every stage against what it should keep."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terracut.llm import quality, queries


def dealt(sizes, weights, share, most):
    """Targets by dealing what is left, by weight, until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, still = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while still:
        each = left / sum(weight[s] for s in still)
        full = {s for s in still if each * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: each * weight[s] for s in still}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        still -= full
    return target


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    plain = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    docs, labels = [], []
    for i in range(900):
        kind = rng.choice(["good", "good", "good", "toxic", "junk"])
        t = say(rng.randint(20, 60))
        if kind != "good":
            w = t.split(" ")
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vile", "scum"]) if kind == "toxic" else rng.choice(["buy", "cheap", "click"]) + "!")
            t = " ".join(w)
        docs.append((i, t, "en", f"s{i % 4}" if i % 5 else None, len(t)))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    bench = [(i, say(20)) for i in range(5)]
    docs += [(2000 + i, f"{say(10)} {bench[i % 5][1]} {say(10)}", "en", "s1", 0) for i in range(10)]
    long = say(80).split(" ")
    docs += [(3000 + i, " ".join(w if k != 7 * i else "other" for k, w in enumerate(long)), "en", "s2", 0) for i in range(6)]
    docs += [(4000, None, "en", "s0", None), (None, say(30), None, None, None)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, corpus):
    docs = queries.table(spark, corpus, "documents")
    kept = corpus_pipeline.quality_classifier(spark, docs, corpus)
    bad = ids(docs.where("text RLIKE 'nasty|vile|scum|buy|cheap|click'"))
    good = ids(docs.where("doc_id < 900")) - bad
    assert kept.columns == docs.columns
    assert len(ids(kept) & bad) <= 0.03 * len(bad) and len(ids(kept) & good) >= 0.93 * len(good)
    near = corpus_pipeline.near_duplicates(spark, docs, corpus)
    assert near.columns == docs.columns and ids(docs) - ids(near) == {3001, 3002, 3003, 3004, 3005}
    clean = corpus_pipeline.decontamination(spark, docs, corpus)
    assert clean.columns == docs.columns and ids(docs) - ids(clean) == {2000 + i for i in range(10)}
    mixed = corpus_pipeline.source_mixing(spark, docs, corpus)
    assert mixed.columns == docs.columns and ids(mixed) <= ids(docs)
    expected = {(r.doc_id, r.source): r.taken // r.size for r in queries.op5_mixing(spark, corpus).join(docs.select("doc_id", "source"), "doc_id").where("taken > 0").collect()}
    counts = {(r.doc_id, r.source): r["count"] for r in mixed.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy("doc_id", "source").count().collect()}  # without words, no copies show in taken
    assert counts == expected
    placed = corpus_pipeline.shards(spark, mixed, corpus)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert placed.count() == mixed.count() and max(sizes) - min(sizes) <= 1


def test_stages_keep_clashing_columns_and_repeated_rows(spark, corpus, tmp_path):
    """Columns named like those that operators use, repeated rows, null ids (a copy of another document among them), through all stages."""
    names = ("id", "proof", "origin", "copies", "copy", "kept_id", "tick", "row", "hash", "n", "grade", "words", "class", "bucket", "t", "key", "own_id", "part", "size", "target", "rank", "text_hash", "kept")
    docs = queries.table(spark, corpus, "documents")
    copy = docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long"))
    twice = docs.where("doc_id = 4 OR doc_id IS NULL")
    docs = docs.unionByName(copy).unionByName(twice).unionByName(twice).withColumns({c: F.concat_ws("/", F.lit(c), F.coalesce("doc_id", F.lit(-1)), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))) for c in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        queries.table(spark, corpus, name).write.parquet(f"{tmp_path}/{name}.parquet")
    whole = queries.table(spark, str(tmp_path), "documents")
    rows = {tuple(r) for r in whole.collect()}
    near = corpus_pipeline.near_duplicates(spark, whole, str(tmp_path))
    assert near.columns == whole.columns and near.count() == whole.count() - 6  # five near copies, and the copy without an id
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, whole, str(tmp_path)).select(*whole.columns)
        assert {tuple(r) for r in out.collect()} <= rows, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*whole.columns, "shard", "slot", "home_shard"]
    got = [tuple(r) for r in out.select(*whole.columns).collect()]
    assert got and set(got) <= rows


def test_run_equals_the_stages_one_by_one(spark, corpus):
    """End to end against plain Python on the ids that each stage by itself keeps."""
    docs = queries.table(spark, corpus, "documents")
    model = quality.train(docs, quality.graded(queries.table(spark, corpus, "labels")), "doc_id", "text", "grade", 3)
    rows = [r for r in docs.collect()]
    batch = pa.array([r.text for r in rows], pa.string())
    good = model.score(quality.features(batch))[1][:, quality.LEAST_GRADE - 1] >= quality.LEAST_TAIL
    rows = [r for r, g in zip(rows, good, strict=True) if g]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    sets = {r.doc_id: shingles(r.text) for r in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = sorted(i for i in sets if i is not None)
    for a in known:
        for b in known:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    rows = [r for r in rows if r.doc_id is None or find(r.doc_id) == r.doc_id]
    bench = [r.text.split() for r in queries.table(spark, corpus, "benchmark").collect()]
    rows = [r for r in rows if not any(" ".join(b) in (r.text or "") for b in bench)]
    size = {s: sum(len((r.text or "").split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    out = corpus_pipeline.run(spark, corpus).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in rows}
    taken = {s: sum(len((r.text or "").split()) for r in out if r.source == s) for s in size}
    goal = dealt(size, [3.0, 1.0, 2.0], 1.5, 2.0)
    assert all(abs(taken[s] - goal[s]) <= 60 + 0.05 * goal[s] for s in size), (taken, goal)
    assert all(n <= 2 for n in Counter(r.doc_id for r in out).values())
    loads = Counter(r.shard for r in out)
    assert max(loads.values()) - min(loads.values()) <= 1
    full = {r.doc_id for r in rows if r.source in {s for s in size if goal[s] >= size[s]} and r.text}
    assert full <= {r.doc_id for r in out}


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == [*queries.table(spark, corpus, "documents").columns, "shard", "slot", "home_shard"]
    rows = out.collect()
    assert rows and len({(r.shard, r.slot) for r in rows}) == len(rows)
    left = {r.doc_id for r in rows}
    assert not left & {2000 + i for i in range(10)} and not left & {3001, 3002, 3003, 3004, 3005}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_run_of_nothing(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        queries.table(spark, corpus, name).where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_of_repeated_rows(spark, tmp_path):
    """A third of all rows are equal: every source's taken words are near its target, as op5's are, and only whole rows repeat."""
    rows = [(i, "alpha beta gamma delta " * (1 + i % 5), f"s{i % 3}") for i in range(600)] + [(1000, "one two three four five six seven eight nine ten", "s0")] * 300
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = queries.table(spark, str(tmp_path), "documents")
    mixed = corpus_pipeline.source_mixing(spark, docs, str(tmp_path))
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    op5 = queries.op5_mixing(spark, str(tmp_path)).join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target")).collect()
    taken = words(mixed)
    for r in op5:
        assert abs(taken[r.source] - r.n) <= 20 and abs(taken[r.source] - r.target) <= 40
    assert mixed.subtract(docs).count() == 0
