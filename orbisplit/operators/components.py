"""Connected components of an edge table by alternating large-star and small-star rounds.

A round is two grouped minima and a join on the node, all combined before they are shuffled: no neighbourhood is ever
gathered. Each round's edges are written to the shared folder, so the plan doesn't grow and a lost executor costs one
round at most. The number of rounds grows with the logarithm of the longest path. Up to LOCAL edges, counted first, are settled by one
task instead: a round is nine exchanges, which cost more than so few edges. Components that get more links are extended: only what the new
links join is looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisplit.sources.tables import materialise

#: Edges up to which one task settles all: two longs each.
LOCAL = 1 << 17


def _stars(edges: DataFrame) -> bool:
    """Whether each node has either larger neighbours only or ONE smaller neighbour in edges (u > v, distinct)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.groupBy("e.n").agg(F.min("e.up").alias("low"), F.max("e.up").alias("high"), F.sum("e.up").alias("smaller"))
    return seen.where("low <> high or smaller > 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all edges (u, v) of a task. Nodes are numbered in their order, so the smaller number of two roots stays one."""
    ends = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*ends, strict=True)]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(*at.reshape(2, -1).tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    labels = nodes[[root(x) for x in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """(node, label) of every node that an edge to another node touches; label is the smallest node of the component."""
    edges = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    edges = materialise(edges, "components")
    if (n := edges.count()) <= local:
        return edges.coalesce(1).mapInArrow(_settled, "node long, label long")
    if n:
        edges = materialise(_small_star(materialise(_large_star(edges.distinct()), "components")), "components")
        while not _stars(edges):
            edges = materialise(_small_star(materialise(_large_star(edges), "components")), "components")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def extended(labels: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """Components (node, label), as ``components`` gives them, after more edges (a, b): those between labels alone are gone through."""
    for c in "ab":
        edges = edges.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    more = materialise(components(edges, "_a", "_b", local), "components")
    moved = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left")
    return moved.select("node", F.coalesce("_to", "label").alias("label")).unionByName(more.join(labels.select("node"), "node", "left_anti"))
