"""A training corpus from raw documents, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread before the next stage. All
but the last return the columns of documents. Rows that a stage keeps are unchanged.

For every stage: null ids, texts and sources are values like others (a null text has no words, is near to nothing and holds
no benchmark item); very long texts count whole; repeated rows are judged alike (in mixing, each is a row of its own);
further columns are carried, whatever their names (the last stage replaces shard, slot and home_shard); an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracut.llm import decontaminate, minhash, mixing, quality, sharding
from terracut.llm.queries import MOST, SHARE, WEIGHTS, table
from terracut.llm.scratch import stored

SHARDS = 16


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good and clean with a probability of quality.LEAST_TAIL or more; fitted on those that are rated."""
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")), "doc_id", "text", "grade", 3)
    return quality.keep_good(docs, model, "text", quality.LEAST_GRADE, quality.LEAST_TAIL)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document of the smallest doc_id."""
    return minhash.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or several times."""
    # Each row has a number of its own, so that of repeated rows each has its own copies. Columns travel as one struct.
    numbered = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number"))
    numbered = stored(numbered, "numbered")
    sized = numbered.select("number", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), mixing.word_count(F.col("row.text")).alias("size"), F.xxhash64("row").alias("tie"))
    mixed = mixing.mix_sources(stored(sized, "sizes"), WEIGHTS, SHARE, MOST, "doc_id", "source", "size", tie_col="tie")
    taken = mixed.where("copies > 0").select("number", F.col("copies").cast("int").alias("copies"))
    return numbered.join(taken, "number").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard, slot and home_shard."""
    return sharding.assign_shards(docs, F.col("doc_id"), [F.octet_length("text"), F.crc32(F.col("text").cast("binary"))], SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", shards),
]

#: A fitted classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
