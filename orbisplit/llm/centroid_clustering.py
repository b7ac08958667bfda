"""Centroid clustering in exact integers, with exponion search.

Each vector carries its cluster, an upper bound of its distance to that centroid and a lower bound of its distance to any other.
Where the bounds don't prove that the cluster stays, the vector is compared with the centroids inside a ball around its current
centroid c, of radius 2 * distance + (distance from c to the centroid nearest to it): neither its nearest nor its second nearest
centroid can lie outside. Distances between centroids are sorted once a round, so a ball is the beginning of a list; what lies on
its surface belongs to it, so ties are settled by number. Components are integers and so are squared distances: bounds only save
work, they never decide.

A round is one narrow pass: rows go from one table in the shared folder to the next, and only sums of centroids (CENTROIDS times the
width, merged by Spark) reach the driver. Nothing is shuffled but those sums, whatever the size of a cluster.

Defined cases: a null vector, one of another width, or one with a null, infinite or NaN component is left out; so is one with a
component beyond LARGEST / SCALE in size, whose squared distances would not fit 64 bits. Rows of one id are vectors each; a
row without an id is clustered but never starts a centroid. With fewer vectors than centroids there are as many centroids as
vectors; an empty table gives an empty result. Sums of distances that pass 64 bits stay at the largest number there is. Further
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisplit.llm.common import work_dir
from orbisplit.sources.tables import delete

CENTROIDS, ROUNDS, WIDTH, SCALE = 40, 5, 64, 256
#: The largest integer component; 64 squares of twice of it stay below 2**62.
LARGEST = 1 << 27
#: Bounds are doubles: they are taken so much wider, relatively.
SLACK = 1e-9
MOST = (1 << 63) - 1
STATE = "vec_id long, x array<int>, cluster int, upper double, lower double"


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of the width with finite components, as integers floor(scale * component)."""
    v = F.col(vector)
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    fits = F.forall(v, lambda c: F.coalesce(F.abs(scaled(c)) <= F.lit(float(LARGEST)), F.lit(False)))  # not for NaN, which is larger than any number
    good = df.where(v.isNotNull() & (F.size(v) == width) & fits)
    return good.select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(scaled(c)).cast("int")).alias("x"))


def starts(vectors: DataFrame, k: int = CENTROIDS, seed: int = 2) -> np.ndarray:
    """The k vectors whose ids hash lowest, in the order of their hashes; of one id the smaller vectors come first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select("x", order.alias("h")).orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([r.x for r in rows], np.int64)


class Search:
    """The centroids of a round, how far each has moved, and for each the others by distance."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centroids = centroids
        k = len(centroids)
        square = np.array([((centroids - c) ** 2).sum(1) for c in centroids])
        gaps = np.sqrt(square.astype(np.float64))
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.sorted = np.take_along_axis(gaps, self.order, 1)
        np.fill_diagonal(gaps, np.inf)
        #: From each centroid to the one nearest to it.
        self.nearest = gaps.min(1) if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64))
        self.moved = moved
        #: The most that any centroid but this one has moved.
        self.others = np.array([np.delete(moved, i).max(initial=0.0) for i in range(k)])

    def to(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared distances to one centroid a row."""
        return ((x - self.centroids[cluster]) ** 2).sum(1)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster and bounds after this round."""
        cluster = cluster.copy()
        upper = (upper + self.moved[cluster]) * (1 + SLACK)
        lower = np.maximum(lower - self.others[cluster], 0.0) * (1 - SLACK)
        stays = np.maximum(lower, self.nearest[cluster] / 2 * (1 - SLACK))
        loose = np.flatnonzero(upper >= stays)
        upper[loose] = np.sqrt(self.to(x[loose], cluster[loose]).astype(np.float64)) * (1 + SLACK)
        at = loose[upper[loose] >= stays[loose]]
        radius = (2 * upper[at] + self.nearest[cluster[at]]) * (1 + SLACK)
        for c in np.unique(cluster[at]):
            own = cluster[at] == c
            self._scan(x, at[own], np.searchsorted(self.sorted[c], radius[own], side="right"), int(c), cluster, upper, lower)
        return cluster, upper, lower

    def _scan(self, x: np.ndarray, rows: np.ndarray, ball: np.ndarray, c: int, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Rows of centroid c against the first so many of its list."""
        rows, ball = (y[np.argsort(-ball, kind="stable")] for y in (rows, ball))
        best = np.full(len(rows), MOST)
        second, number = best.copy(), np.full(len(rows), len(self.centroids))
        mine = x[rows]
        for j in range(int(ball[0])):
            n = int(np.searchsorted(-ball, -j, side="left"))  # those with a larger ball
            new = int(self.order[c, j])
            d = ((mine[:n] - self.centroids[new]) ** 2).sum(1)
            first = (d < best[:n]) | ((d == best[:n]) & (new < number[:n]))
            second[:n] = np.where(first, best[:n], np.minimum(second[:n], d))
            best[:n], number[:n] = np.where(first, d, best[:n]), np.where(first, new, number[:n])
        cluster[rows] = number
        upper[rows] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        lower[rows] = np.where(second == MOST, np.inf, np.sqrt(second.astype(np.float64)) * (1 - SLACK))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1).astype(np.int64)


def _passed(rows: DataFrame, search: Search) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bounds = (np.asarray(b.column(c)) for c in ("cluster", "upper", "lower"))
                cluster, upper, lower = search.assign(_matrix(b), *bounds)
                columns = [b.column("vec_id"), b.column("x"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "cluster", "upper", "lower"])

    return rows.mapInArrow(run, STATE)


def _sums(state: DataFrame, k: int, width: int) -> dict[int, tuple[int, list[int]]]:
    """How many rows each cluster has, and their sums: added up in the tasks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x, cluster = _matrix(b), np.asarray(b.column("cluster"))
                for c in np.unique(cluster):
                    own = x[cluster == c]
                    total[c, :width] += own.sum(0)
                    total[c, width] += len(own)
        c, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(total[c, i])], ["c", "i", "s"])

    out = np.zeros((k, width + 1), object)
    for r in state.select("x", "cluster").mapInArrow(run, "c long, i long, s long").groupBy("c", "i").agg(F.sum("s").alias("s")).collect():  # k * width rows
        out[r.c, r.i] = r.s
    return {c: (int(row[-1]), [int(s) for s in row[:-1]]) for c, row in enumerate(out)}


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance) of every vector, the distance squared, and the centroids."""
    spark = df.sparkSession
    vectors = integers(df, width=width)
    centroids = starts(vectors, k, seed)
    if not len(centroids):
        return vectors.where("false").select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state = vectors.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    before, old = None, None
    for n in range(rounds + 1):
        path = work_dir(spark, f"clusters-{n}")
        _passed(state, Search(centroids, before)).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if old:
            delete(spark, old)  # the next one is whole
        old = path
        if n < rounds:
            before = centroids
            sums = _sums(state, len(centroids), width)
            centroids = np.array([[s // m for s in row] if (m := sums[c][0]) and (row := sums[c][1]) else before[c] for c in range(len(before))], np.int64)
    last = Search(centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = last.to(_matrix(b), np.asarray(b.column("cluster")))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), b.column("cluster"), pa.array(d)], ["vec_id", "x", "cluster", "distance"])

    return state.mapInArrow(measure, "vec_id long, x array<int>, cluster int, distance long"), centroids


def report(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    rows, centroids = cluster(df, k, rounds, width, seed)
    rows = rows.drop("x")
    found = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = min(sum(found.values()), MOST)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = [(c, min(found.get(c, 0), MOST), total, digest(x)) for c, x in enumerate(centroids)]
    table = df.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
