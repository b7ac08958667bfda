"""Local density, local intrinsic dimensionality, dense runs, warps, and radii that adapt to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbisplit.functions.vectors import dot
from orbisplit.operators.blocks import matrix
from orbisplit.operators.pairs import distances, knn, knn_cross
from orbisplit.operators.quantiles import exact_quantiles
from orbisplit.operators.scans import Scan
from orbisplit.sources.tables import materialise

DENSITY_K, LID_K = 10, 20
SMALL = 1e-8
LID_LOW, LID_HIGH = 0.1, 100.0


def local_density(p: DataFrame, k: int = DENSITY_K, metric: str = "cosine") -> DataFrame:
    """(id, density): one over the mean distance to the k nearest others; one for a single row."""
    k = min(k, p.count() - 1)
    if k < 1:
        return p.select("id", F.lit(1.0).alias("density"))
    return density_of(knn(p, k, metric), k)


def density_of(neighbours: DataFrame, k: int) -> DataFrame:
    """(id, density) of ranked neighbours (l, d, rank)."""
    return neighbours.where(F.col("rank") <= k).groupBy(F.col("l").alias("id")).agg((1.0 / (F.avg("d") + SMALL)).alias("density"))


def lid_of(neighbours: DataFrame, k: int) -> DataFrame:
    """(id, lid) of ranked neighbours (l, d, rank): the maximum-likelihood estimate over the first k - 1 against the k-th."""
    floor = lambda c: F.greatest(c, F.lit(1e-10))
    last = F.max("d").over(Window.partitionBy("l"))
    ratio = F.when(F.col("rank") < k, F.log(floor(F.col("last")) / floor(F.col("d"))))
    raw = 1.0 / (F.avg(ratio) + SMALL)
    clamped = F.when(raw.isNull(), F.lit(float("nan"))).otherwise(F.least(F.greatest(raw, F.lit(LID_LOW)), F.lit(LID_HIGH)))
    return neighbours.withColumn("last", last).groupBy(F.col("l").alias("id")).agg(clamped.alias("lid"))


def lid(p: DataFrame, k: int = LID_K, metric: str = "cosine") -> DataFrame:
    """(id, lid); one for a single row, not a number where k is one."""
    k = min(k, p.count() - 1)
    if k < 1:
        return p.select("id", F.lit(1.0).alias("lid"))
    return lid_of(knn(p, k, metric), k)


def lid_at(at: DataFrame, p: DataFrame, k: int = LID_K, metric: str = "cosine") -> DataFrame:
    """(id, lid) of some of the points alone, each against all of them."""
    k = min(k, p.count() - 1)
    if k < 1:
        return at.select("id", F.lit(1.0).alias("lid"))
    return lid_of(distances(at, p, metric, k=k, other=True), k)


def density_stats(p: DataFrame, metric: str = "cosine") -> DataFrame:
    """One row: count; mean, sample deviation, extremes and quartiles of density and dimensionality. Both come from one search for neighbours."""
    k = min(LID_K, p.count() - 1)
    if k < 1:
        both = p.select("id", F.lit(1.0).alias("density"), F.lit(1.0).alias("lid"))
    else:
        near = materialise(knn(p, k, metric), "neighbours")
        both = density_of(near, min(DENSITY_K, k)).join(lid_of(near, k), "id")
    both = materialise(both, "densities")
    at = exact_quantiles(both, dict.fromkeys(("density", "lid"), (0.25, 0.5, 0.75, 0.95)))
    some = F.count(F.lit(1)) > 0
    out = [F.count(F.lit(1)).alias("num_points")]
    for c in ("density", "lid"):
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
        out += [F.when(some, F.lit(x)).alias(f"{c}_p{q}") for q, x in zip((25, 50, 75, 95), at[c], strict=True)]
    return both.agg(*out)


def dense_runs(density: DataFrame, threshold: float = 1.5, run: str | None = None) -> DataFrame:
    """(run_start, run_end): maximal runs of consecutive ids, ends included, with density above threshold times the mean.

    ``run`` names a column of trajectories; without one all rows are one trajectory. Dense rows alone are kept, and then numbered by a
    scan that cuts a long trajectory over many tasks."""
    by = [run] if run else []
    mean = density.agg(F.avg("density")).first()[0]
    if mean is None:
        return density.select(*by, F.col("id").alias("run_start"), F.col("id").alias("run_end")).limit(0)
    dense = density.where(F.col("density") > threshold * mean).select(*by, "id")
    numbered = Scan(dense, by, ["id"]).number("_at").rows().withColumn("island", F.col("id") - F.col("_at"))
    return numbered.groupBy(*by, "island").agg(F.min("id").alias("run_start"), F.max("id").alias("run_end")).drop("island")


def lid_warp(p: DataFrame, metric: str = "cosine") -> DataFrame:
    """(id, v, factor): vectors stretched by 1 to 3, most where the dimensionality is low."""
    lids = materialise(lid(p, metric=metric), "lids")
    low, high = exact_quantiles(lids, {"lid": [0.05, 0.95]})["lid"]
    place = (F.col("lid") - low) / (high - low + SMALL)
    factor = 1.0 + 2.0 * (1.0 - F.greatest(F.least(place, F.lit(1.0)), F.lit(0.0)))
    joined = p.join(lids, "id").withColumn("factor", factor)
    return joined.select("id", F.transform("v", lambda x: x * F.col("factor")).alias("v"), "factor")


def pca(p: DataFrame, components: int) -> DataFrame:
    """(id, pc): the centred vectors on their first principal axes; the sign of an axis is free, and made such that its
    largest weight is positive. The covariance is summed over partitions: width squared is what meets on the driver."""
    return p.select("id", project(F.col("v"), principal_axes(p, components)).alias("pc"))


def principal_axes(p: DataFrame, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the first axes (a column each) of points, to project other tables on as well."""
    mean, axes, _, _ = _axes(p)
    return mean, axes[:, :components]


def project(v: Column, axes: tuple[np.ndarray, np.ndarray]) -> Column:
    """A vector's coordinates on axes."""
    mean, top = axes
    lit = lambda x: F.array(*[F.lit(float(y)) for y in x])
    return F.array(*[dot(v, lit(w)) - F.lit(float(mean @ w)) for w in top.T])


def _axes(p: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                v = np.vstack(b["v"])
                n, s, q = n + len(v), s + v.sum(0), q + v.T @ v
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    element = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.struct(i.alias("i"), F.get(c, i).alias("x")))
    parts = p.mapInPandas(sums, "n long, s array<double>, q array<double>")
    n = parts.agg(F.sum("n")).first()[0]
    if not n:
        raise ValueError("no points")
    total = {}
    for c in ("s", "q"):
        rows = parts.select(F.explode(element(F.col(c))).alias("e")).groupBy("e.i").agg(F.sum("e.x").alias("x")).orderBy("i").collect()
        total[c] = np.array([r.x for r in rows])
    mean = total["s"] / n
    cov = (total["q"].reshape(len(mean), -1) - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return mean, axes, values, n


def whiten(p: DataFrame) -> DataFrame:
    """(id, v): centred, on principal axes, each of variance one; as wide as the smaller of rows and dimensions."""
    mean, axes, values, n = _axes(p)
    width = min(n, len(mean))
    scale = axes[:, :width] / np.sqrt(np.maximum(values[:width], 1e-24))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": list((np.vstack(b["v"]) - mean) @ scale)})

    return p.mapInPandas(run, "id long, v array<double>")


def _around(centers: DataFrame, p: DataFrame, k: int, metric: str) -> DataFrame:
    """The k nearest points of each centre, without a first one at distance zero; ranks from 1."""
    near = knn_cross(centers, p, k + 1, metric)
    self_match = F.max(F.when((F.col("rank") == 1) & (F.col("d") < 1e-6), 1).otherwise(0)).over(Window.partitionBy("l"))
    more = F.max("rank").over(Window.partitionBy("l")) > k
    near = near.withColumn("drop", F.when(more, self_match).otherwise(F.lit(0)))
    return near.withColumn("rank", F.col("rank") - F.col("drop")).where((F.col("rank") >= 1) & (F.col("rank") <= k)).drop("drop")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def adaptive_radius(
    centers: DataFrame, p: DataFrame, base: float, method: str = "LID", low: float = 0.01, high: float = 0.5, factor: float = 1.0, metric: str = "cosine"
) -> DataFrame:
    """(id, radius) of centres (id, v). Methods LID, density and kNN; any other gives the base radius."""
    n = p.count()
    k = min(LID_K if method == "LID" else DENSITY_K, n - 1)
    if method not in ("LID", "density", "kNN") or k < 1:
        return centers.select("id", F.lit(float(base)).alias("radius"))
    near = _around(centers, p, k, metric)
    if method == "kNN":
        out = near.groupBy("l").agg((F.avg("d") * factor).alias("r"))
    elif method == "density":
        mean = local_density(p, DENSITY_K, metric).agg(F.avg("density")).first()[0]
        out = near.groupBy("l").agg((1.0 / (F.avg("d") + SMALL)).alias("own"))
        out = out.withColumn("r", base * (1.0 / (F.sqrt(F.col("own") / (mean + SMALL)) + SMALL)) * factor)
    else:
        out = _local_lid(near, p, metric).withColumn("r", base * (F.col("scale") / 4.0) * factor)
    return out.select(F.col("l").alias("id"), clamp(F.col("r"), low, high).alias("radius"))


def _local_lid(near: DataFrame, p: DataFrame, metric: str) -> DataFrame:
    """(l, scale): the mean dimensionality within each centre's neighbourhood of at most LID_K rows, between 0.5 and 10."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        v = np.vstack(group.sort_values("rank")["v"])
        mean = 1.0
        if len(v) > 1:
            d = matrix(v, v, metric)
            np.fill_diagonal(d, np.inf)
            k = min(LID_K, len(v) - 1)
            d = np.maximum(np.sort(d, axis=1)[:, :k], 1e-10)
            logs = np.log(d[:, -1:] / d[:, :-1])
            mean = float(np.clip(1.0 / (logs.mean(1) + SMALL), LID_LOW, LID_HIGH).mean()) if k > 1 else float("nan")
        return pd.DataFrame({"l": [group["l"].iloc[0]], "scale": [max(0.5, 10.0 if mean != mean else min(10.0, mean))]})

    joined = near.join(p.withColumnRenamed("id", "r"), "r").select("l", "rank", "v")
    return joined.groupBy("l").applyInPandas(one, "l long, scale double")
