"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has `ticks` positions. Every shard owns `vnodes` of them, placed by hash; a key stands at the tick of its
hash and belongs to the next virtual node clockwise. A shard takes keys up to its share of all rows. What is over
continues clockwise, virtual node by virtual node, to the first shard with room. The shares add up to the number of
rows, so every row finds a place and shard sizes are at most one row apart.

What moves is decided on counts of ticks, a table whose size is set by the ring and not by the data. Rows only look up
their tick's ranges of ranks, so the one shuffle of rows is spread over all ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TICKS = 1 << 15
VNODES = 64


def digest(value: Column) -> Column:
    """MD5 of a value's text, null like the empty text: a hash that other systems compute alike."""
    return F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def tick_of(hashed: Column, ticks: int) -> Column:
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % ticks


def ring(spark: SparkSession, shards: int, vnodes: int, ticks: int) -> DataFrame:
    """tick, arc, owner: for every tick the next virtual node clockwise. Its size depends on the ring alone."""
    nodes = (
        spark.range(shards * vnodes, numPartitions=1)
        .select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), tick_of(digest(F.concat(F.lit("vnode:"), F.col("id"))), ticks).alias("tick"))
        .groupBy("tick")
        .agg(F.min("shard").alias("shard"))
    )
    onward = W.orderBy(F.desc("tick")).rowsBetween(W.unboundedPreceding, 0)  # running, so linear in the ring
    whole = W.orderBy("tick").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    node = F.when(F.col("shard").isNotNull(), F.struct(F.col("tick").alias("arc"), F.col("shard").alias("owner")))
    at = F.coalesce(F.last(node, ignorenulls=True).over(onward), F.first(node, ignorenulls=True).over(whole))
    return spark.range(ticks, numPartitions=1).withColumnRenamed("id", "tick").join(nodes, "tick", "left").select("tick", at.alias("node")).select("tick", "node.arc", "node.owner")


def placement(counts: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """tick, owner, lo, hi, shard, slot: ranks lo .. hi - 1 of the tick's keys go to the shard, from that slot on.

    counts: tick, n. First every shard keeps what is its own, in ring order, up to its share. Then what is over walks
    on clockwise, one tick's remainder after another, and takes what room is left.
    """
    per_tick = nodes.join(counts, "tick", "left").select("tick", "arc", "owner", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    everything = W.partitionBy(F.lit(0))
    own = W.partitionBy("owner").orderBy("tick").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("n").over(everything)
    share = F.floor(F.col("total") / shards) + F.when(F.col("owner") < F.col("total") % shards, 1).otherwise(0)
    kept = (
        per_tick.withColumn("total", total)
        .withColumn("share", share.cast("long"))
        .withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
        .withColumn("stay", F.greatest(F.lit(0), F.least(F.col("n"), F.col("share") - F.col("before"))))
    )
    own_ranges = kept.where("stay > 0").select("tick", "owner", F.lit(0).cast("long").alias("lo"), F.col("stay").alias("hi"), F.col("owner").alias("shard"))
    # The second walk: one row for each arc, with its remainder (the last keys of its ticks), the room its owner has left,
    # and the shards in the order in which they come up clockwise.
    clockwise = W.partitionBy(F.lit(0)).orderBy("arc")
    arcs = (
        kept.groupBy("arc", "owner")
        .agg(F.sum(F.col("n") - F.col("stay")).alias("over"), F.max("share").alias("share"), F.sum("stay").alias("stay"))
        .withColumn("room", F.max("share").over(W.partitionBy("owner")) - F.sum("stay").over(W.partitionBy("owner")))
        .withColumn("at", F.row_number().over(clockwise))
        .withColumn("owners", F.collect_list("owner").over(clockwise.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .select("arc", "owner", "over", "room", F.expr("if(over > 0, array_distinct(concat(slice(owners, at + 1, size(owners)), slice(owners, 1, at))), array())").alias("route"))
    )
    state = arcs.groupBy().agg(
        F.sort_array(F.collect_list(F.when(F.col("over") > 0, F.struct("arc", "over", "route")))).alias("arcs"),
        F.map_from_entries(F.collect_set(F.struct("owner", "room"))).alias("rooms"),
    )
    walk = F.expr(
        f"""aggregate(
          arcs,
          named_struct('room', transform(sequence(0, {shards - 1}), s -> coalesce(rooms[s], 0L)),
                       'moves', cast(array() AS array<struct<arc: bigint, lo: bigint, hi: bigint, shard: int>>)),
          (st, a) -> aggregate(
            a.route,
            named_struct('left', a.over, 'done', 0L, 'room', st.room, 'moves', st.moves),
            (t, s) -> if(t.left = 0 OR t.room[s] = 0, t, named_struct(
              'left', t.left - least(t.left, t.room[s]),
              'done', t.done + least(t.left, t.room[s]),
              'room', transform(t.room, (r, k) -> if(k = s, r - least(t.left, r), r)),
              'moves', concat(t.moves, array(named_struct('arc', a.arc, 'lo', t.done, 'hi', t.done + least(t.left, t.room[s]), 'shard', s))))),
            t -> named_struct('room', t.room, 'moves', t.moves)),
          st -> st.moves)"""
    )
    moves = state.select(F.explode(walk).alias("m")).select("m.*")
    # From ranges of an arc's remainder to ranges of its ticks.
    rest = kept.withColumn("rest", F.col("n") - F.col("stay")).where("rest > 0")
    run = W.partitionBy("arc").orderBy("tick").rowsBetween(W.unboundedPreceding, -1)
    rest = rest.withColumn("from", F.coalesce(F.sum("rest").over(run), F.lit(0)))
    cut_lo, cut_hi = F.greatest("from", "lo"), F.least(F.col("from") + F.col("rest"), F.col("hi"))
    moved = rest.join(moves, "arc").where(cut_lo < cut_hi).select("tick", "owner", (F.col("stay") + cut_lo - F.col("from")).alias("lo"), (F.col("stay") + cut_hi - F.col("from")).alias("hi"), "shard")
    filled = W.partitionBy("shard").orderBy("tick", "lo").rowsBetween(W.unboundedPreceding, -1)
    return own_ranges.unionByName(moved).withColumn("slot", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(filled), F.lit(0)))


def assign_shards(rows: DataFrame, key: Column, tie: list[Column], shards: int, vnodes: int = VNODES, ticks: int = TICKS) -> DataFrame:
    """rows with shard (0-based int), slot (gapless from 0 in each shard) and home_shard (the owner before any overflow).

    key decides the place on the ring; tie orders rows of one tick (by a hash of tie, then of key), and so which of them
    move on. Rows equal in key and tie are interchangeable; they are sorted (spilling if need be) in one task, like all
    rows of one tick and one of its 256 parts. Null keys have a place like any other, long texts are only measured by
    what key and tie make of them. An empty table gives an empty table. Columns named shard, slot or home_shard are
    replaced; all others stay, whatever their names.
    """
    if shards < 1 or ticks < 4 * shards * vnodes:
        raise ValueError("shards must be positive, and ticks at least four for each virtual node")
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "home_shard")
    part = F.conv(F.substring(F.md5(F.concat_ws(":", *[t.cast("string") for t in tie]).cast("binary")), 1, 2), 16, 10).cast("int") if tie else F.lit(0)
    ties = [t.alias(f"tie{i}") for i, t in enumerate(tie)]
    # The caller's columns travel as one struct, so their names cannot clash.
    rows = rows.select(F.struct("*").alias("row"), tick_of(digest(key), ticks).alias("tick"), part.alias("part"), digest(key).alias("hashed"), key.alias("key"), *ties)
    # Ranks in a tick: those of the parts before, and the row's own in its part. So a hot key meets in 256 tasks, not in one.
    counts = rows.groupBy("tick", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("tick").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("tick", "part", before.alias("first"))
    ranges = placement(counts.groupBy("tick").agg(F.sum("n").alias("n")), ring(spark, shards, vnodes, ticks), shards)
    per_tick = ranges.groupBy("tick").agg(F.first("owner").alias("home"), F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("ranges"))
    own = F.row_number().over(W.partitionBy("tick", "part").orderBy("hashed", "key", *[f"tie{i}" for i in range(len(tie))])) - 1
    ranked = rows.withColumn("own", own).join(first, ["tick", "part"]).withColumn("rank", (F.col("own") + F.col("first")).cast("long"))
    # per_tick has at most `ticks` rows and, in all, ticks + vnodes * shards**2 ranges: fixed by the ring, about 3 MB.
    hit = F.element_at(F.filter("ranges", lambda r: (F.col("rank") >= r["lo"]) & (F.col("rank") < r["hi"])), 1)
    placed = ranked.join(F.broadcast(per_tick), "tick").withColumn("hit", hit)
    return placed.select("row.*", F.col("hit.shard").alias("shard"), (F.col("hit.slot") + F.col("rank") - F.col("hit.lo")).alias("slot"), F.col("home").alias("home_shard"))
