"""Connected components of a table of links, as a DataFrame loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracut.llm.scratch import stored

#: Links that a task follows by itself (4 MB); more take rounds over all tasks.
FEW = 1 << 18


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), ascending, and the smallest node reachable from each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        # Roots are hooked to the smaller root at a link's other end, then paths are cut short.
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def smallest_reachable(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node of links (a, b).

    Large-star and small-star rounds: every node's larger neighbours move to its smallest neighbour, then every node and
    its smaller neighbours do. Links end as stars around the smallest node of each component, in about log(n) rounds. A
    hub's links meet only in aggregates and in joins on its own name, which adaptive execution splits. FEW links at most are
    followed in one task instead: rounds over so few cost their start alone.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.count() <= FEW:

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
            if parts:
                node, component = least_of(*(np.concatenate(side) for side in zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])

        return edges.coalesce(1).mapInArrow(follow, "node long, component long")
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = stored(small.where("u != v").distinct(), "small-star")
        # Stars and nothing else: every u has one v, and no v is a u.
        sides = small.select(F.col("u").alias("n"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionAll(small.select("v", F.lit(0), F.lit(1)))
        is_star = sides.groupBy("n").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v")).where("as_u > 1 OR as_u = 1 AND as_v = 1").isEmpty()
        edges = small
        if is_star:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
