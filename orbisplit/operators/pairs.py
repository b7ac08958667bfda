"""Distances between two tables of vectors by blocks.

Both sides are packed into blocks of about BLOCK rows by a hash of the id; pairs of blocks go through one matrix product
each and send on only what is asked for (all pairs, those within a radius, or the k nearest). Memory is two blocks and
their distances, whatever the tables' sizes. The blocks of the right side are broadcast if their bytes, counted first, are
within BROADCAST; otherwise pairs of blocks are dealt over tiles. Pairs within a radius, and nearest neighbours of more
rows than that, go by cells of the metric space instead (see cells.py), where most pairs of blocks never meet if the rows are clustered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbisplit.functions.vectors import METRICS, doubles
from orbisplit.operators import cells
from orbisplit.operators.blocks import BLOCK, BROADCAST, SIDE, SIDES, close_kernel, each_pair, matrix, nearest_kernel, own_kernel, packed, pair_band, tiles

__all__ = ["distances", "knn", "knn_cross", "matrix", "nearest", "pair_histogram", "pair_values", "points", "self_pairs"]

#: Rows of the right side up to which all blocks meet: describing cells would cost more than it saves.
PLAIN = 8192


def points(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): ids as longs, vectors as doubles; rows without a vector are left out."""
    return df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), doubles(F.col(vector)).alias("v"))


def distances(
    left: DataFrame, right: DataFrame, metric: str = "cosine", within: float | None = None, k: int | None = None, other: bool = False, labels: bool = False
) -> DataFrame:
    """(l, r, d) of points (id, v). within: distances up to it; k: the k nearest, ties by id; other: not a row with itself; labels: points
    are (id, v, label), and pairs of different labels are left out. Ids of a side may repeat."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    n_left, (n_right, width) = left.count(), right.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    few, light = n_left <= (PLAIN if k is None else BLOCK), n_right * (width or 1) * 8 <= BROADCAST
    if within is not None and k is None and n_right > PLAIN and not few:
        return cells.close_pairs(left, cells.build(right, n_right, metric), within, other, labels)
    if k is not None and within is None and not labels and not light and not few:
        return nearest(cells.nearest_by_cells(left, cells.build(right, n_right, metric), k, other)[0], k)
    slots = left.sparkSession.sparkContext.defaultParallelism
    if few and n_right > PLAIN:  # the left side is sent, and the right one stays where it is
        a, b = packed(left, max(1, -(-n_left // BLOCK)), "l", labels), packed(right, max(slots, -(-n_right // BLOCK)), "r", labels)
        pairs = b.join(F.broadcast(a), how="cross")
    elif not light:
        pairs = tiles(left, right, n_left, n_right, width, SIDES if k is not None else (SIDE, SIDE), labels)
    else:
        a = packed(left, max(1, min(max(slots, -(-n_left // BLOCK)), max(n_left, 1))), "l", labels)
        b = packed(right, max(1, -(-n_right // BLOCK)), "r", labels)
        pairs = a.join(F.broadcast(b), how="cross")
    run = close_kernel(metric, within, other, labels) if k is None else nearest_kernel(k, metric, other, labels, within)
    out = pairs.select("l_block", "l_ids", "l_v", "r_ids", "r_v", *["l_labels", "r_labels"] * labels).mapInArrow(run, "l long, r long, d double")
    return out if k is None else nearest(out, k)


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs with the smallest distance of each left row, with their rank from 1."""
    by = Window.partitionBy("l").orderBy("d", "r")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def self_pairs(p: DataFrame, metric: str = "cosine", within: float | None = None, labels: bool = False) -> DataFrame:
    """(l, r, d) with l < r."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if within is not None and (n := p.count()) > PLAIN:
        return cells.close_self_pairs(cells.build(p, n, metric), within, labels)

    return each_pair(p, labels).mapInArrow(own_kernel(metric, within, labels), "l long, r long, d double")


def pair_histogram(p: DataFrame, metric: str, low: float, high: float, bins: int) -> DataFrame:
    """(b, c, low, high): how many pairs have distances from low to high, by bin, and the least and largest in each; as bin -1 how many are
    smaller, and as one more bin how many are larger. Bins are counted where distances are made: no pair leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, least, most = np.zeros(bins + 2, np.int64), np.full(bins + 2, np.inf), np.full(bins + 2, -np.inf)
        for batch in batches:
            for row in range(batch.num_rows):
                n, below, x = pair_band(batch, row, metric, low, high)
                at = place_of(x, low, high, bins) + 1
                count += np.bincount(at, minlength=bins + 2)
                count[0] += below
                count[-1] += n - below - len(x)
                np.minimum.at(least, at, x)
                np.maximum.at(most, at, x)
        b = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (b - 1, count[b], least[b], most[b])], ["b", "c", "low", "high"])

    parts = each_pair(p).mapInArrow(run, "b long, c long, low double, high double")
    return parts.groupBy("b").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))


def place_of(x: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    if bins == 1 or not low < high:
        return np.zeros(len(x), np.int64)
    return np.clip(np.floor((x - low) / (high - low) * bins), 0, bins - 1).astype(np.int64)


def pair_values(p: DataFrame, metric: str, low: float, high: float) -> DataFrame:
    """(d): the distances of pairs from low to high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(pair_band(batch, row, metric, low, high)[2])], ["d"])

    return each_pair(p).mapInArrow(run, "d double")


def knn(p: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest other rows of each row."""
    return distances(p, p, metric, k=k, other=True)


def knn_cross(queries: DataFrame, references: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest references of each query; fewer if there are fewer."""
    return distances(queries, references, metric, k=k)
