"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operations only.

Documents are dealt to runs by a hash of their id. Every partition sorts its digests and collapses equal ones, so what
it sends to a run is a sorted run itself: one row of a digest, however many copies there are. Then runs meet in rounds.
In each round `fan_in` neighbouring runs are exchanged, merged in order of their digests, and collapsed again: a sorted
aggregate walks the merged run and keeps of neighbours with one digest the smallest id and the number of documents.

A run's number is held digit by digit (in base fan_in), and runs are sorted by digest before these digits. So a merged
run is in the order that the next round's first half reads it in, and no level sorts its input again before sending.
The last level's keepers go back to the runs (at most one row of a digest for each run), and from there to the documents
of the run, so no task ever holds a whole group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracut.llm.scratch import stored

#: Runs of ASCII white space other than a lone space; a lone space stays as it is.
WIDE_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

#: What must agree before two texts count as equal: SHA-256, and, as a second look at every level, an unrelated 64-bit hash and the length.
DIGEST = ["digest", "proof", "n_bytes"]


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WIDE_SPACE, " ")


def digits(runs: int, fan_in: int) -> int:
    """Rounds that merge this many runs into one: how many digits a run's number has."""
    n = 0
    while fan_in**n < runs:
        n += 1
    return n


def digest_runs(docs: DataFrame, id_col: str, text_col: str, runs: int, fan_in: int) -> DataFrame:
    """id, digest and the digits r1, r2, ... of the run (the last one first to be merged) of every document."""
    run = F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int")
    n = digits(runs, fan_in)
    return (
        docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
        .select("id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("proof"), F.octet_length("norm").alias("n_bytes"), run.alias("run"))
        .select("id", *DIGEST, *[(F.floor(F.col("run") / fan_in ** (n - i)) % fan_in).cast("int").alias(f"r{i}") for i in range(1, n + 1)])
    )


def merged(rows: DataFrame, run: list[str]) -> DataFrame:
    """Runs of sorted rows merged: of each run and digest the least keeper and the number of documents it stands for.

    The keeper is a struct (is the id null, id), so null loses against any id. Its minimum is no value that a hash
    aggregate could update in place: Spark merges in order of the keys instead.
    """
    return rows.groupBy(*DIGEST, *run).agg(F.min("keeper").alias("keeper"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Nulls: a null text is an empty text, and all empty texts are one group. A null id never wins over another id; where
    all ids of a group are null, keep_id is null and its rows are kept. Repeated rows (same id, same text) are copies of
    one document: each counts in group_size, and all carry the same decision. Ties cannot occur otherwise: the smallest
    id wins. Very long texts count whole; only their digests are exchanged. An empty table gives an empty table. Only
    id_col and text_col are read, so other columns cannot clash.
    """
    if runs < 1 or fan_in < 2:
        raise ValueError("there must be a run at least, and two runs in a merge")
    table = stored(digest_runs(docs, id_col, text_col, runs, fan_in), "digests")
    run = [f"r{i}" for i in range(1, digits(runs, fan_in) + 1)]
    base = merged(table.select(*DIGEST, *run, F.struct(F.col("id").isNull().alias("none"), "id").alias("keeper"), F.lit(1).cast("long").alias("group_size")), run)
    level = base
    for left in range(len(run) - 1, -1, -1):
        level = merged(level, run[:left])
    top = level.select(*DIGEST, F.col("keeper.id").alias("keep_id"), "group_size")
    per_run = base.select(*DIGEST, *run).join(top, DIGEST)
    return table.join(per_run, [*DIGEST, *run]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
