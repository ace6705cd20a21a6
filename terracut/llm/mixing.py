"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / size of the source. The running sum of expected
copies is laid over the integers with one random offset for the source, and a document is taken once for each integer
boundary that its part crosses. Documents stand in order of size classes, so each class gets its share and the words
taken come near the target.

The running sum is rank times rate. Ranks come in two steps, so that no task sees a whole source: counts of buckets
(source, size class, hash of the document) give each bucket its first rank, and rows are numbered within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of a source's size class, a power of two. A bucket is the beginning of the hash that orders its rows, so more of
#: them make smaller tasks and the same mix. Buckets are counted (SPREAD rows for each source and size class), not collected.
SPREAD = 1024


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, target: `share` of all sizes dealt out by weight, none above `most` times the source's size.

    sizes: source, size. Sources in code point order, null last, get the weights in turn. What a full source cannot
    take is dealt again by weight among the others; with sources in order of size for weight, those filled are the
    first ones, so running sums give the level at which dealing stops. Sources are few against documents: their table, one
    row each, is sorted in one task.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    one = W.partitionBy(F.lit(0))  # one row for each source
    place = (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    by_level = one.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("weight"))
    t = t.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(whole))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0))
    heavy = F.col("all_weight") - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))
    t = t.withColumn("full", left * F.col("weight") >= F.col("cap") * heavy)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0.0))
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(whole), F.lit(0.0))
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("budget") - spent) * F.col("weight") / (F.col("all_weight") - used))
    return t.select("source", "source_size", target.alias("target"))


def size_class(size: Column) -> Column:
    """Eight classes for each doubling of the size."""
    top = F.length(F.bin(size)) - 1
    return F.when(size > 0, 8 * top + F.floor(size * 8 / F.pow(F.lit(2.0), top)) % 8).otherwise(-1).cast("int")


def order_hash(id_: Column) -> Column:
    return F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))


def systematic_copies(rows: DataFrame, targets: DataFrame, id_col: str, source_col: str, size_col: str, seed: int = 7, spread: int = SPREAD, tie_col: str | None = None) -> DataFrame:
    """rows with source_size, target and copies (how often the mix takes the row).

    Null sources are a source of their own; null ids stand together. Rows of one size class stand in order of a hash of
    their id, then id, size and tie_col (where given), so rows equal in these are interchangeable. Rows of one source, class and bucket are sorted in one
    task, spilling if need be; spread is the number of buckets. A source with target or size 0 gets no copies. An empty
    table gives an empty table. Columns named source_size, target or copies are replaced; all others stay, whatever
    their names.
    """
    rows = rows.drop("source_size", "target", "copies")
    hashed = order_hash(F.col(id_col))
    # The caller's columns travel as one struct, so their names cannot clash.
    rows = rows.select(
        F.struct("*").alias("row"), size_class(F.col(size_col)).alias("class"), hashed.alias("hashed"), F.col(id_col).alias("id"), F.col(size_col).alias("size"), (F.col(tie_col) if tie_col else F.lit(0)).alias("tie"),
        F.floor(F.conv(F.substring(hashed, 1, 7), 16, 10).cast("long") * spread / (1 << 28)).cast("int").alias("bucket"), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("key"),
    )
    bucket = ["key", "class", "bucket"]
    # Rows before a bucket: those of the classes before, and of its own class's buckets before.
    counts = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = counts.groupBy("key", "class").agg(F.sum("n").alias("n")).select("key", "class", before(W.partitionBy("key").orderBy("class")).alias("ahead"))
    first = counts.withColumn("within", before(W.partitionBy("key", "class").orderBy("bucket"))).join(classes, ["key", "class"]).select(*bucket, (F.col("ahead") + F.col("within")).alias("first"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    rates = targets.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("offset"),
    )
    rank = F.row_number().over(W.partitionBy(*bucket).orderBy("hashed", "id", "size", "tie")) + F.col("first")
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return rows.join(first.join(rates, "key"), bucket).withColumn("rank", rank).select("row.*", "source_size", "target", crossed.cast("long").alias("copies"))


def mix_sources(docs: DataFrame, weights: list[float], share: float, most: float, id_col: str, source_col: str, size_col: str, seed: int = 7, tie_col: str | None = None) -> DataFrame:
    """systematic_copies() with the targets of source_targets()."""
    sizes = docs.select(F.col(source_col).alias("source"), F.col(size_col).alias("size"))
    return systematic_copies(docs, source_targets(sizes, weights, share, most), id_col, source_col, size_col, seed, tie_col=tie_col)
