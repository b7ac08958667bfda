"""Anchors (spheres with shells) and what lies within them.

Anchors are rows (anchor_id, center, base_radius, buffer_radius, shells), shells an array of (inner, outer, split), half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisplit.operators.pairs import distances

SHELL = "array<struct<inner:double,outer:double,split:string>>"
ANCHOR = f"anchor_id long, center array<double>, base_radius double, buffer_radius double, shells {SHELL}"


def shells(radius: Column, dim: int, strategy: str = "inner_val", ratio: float = 0.5, enabled: bool = True, coin: Column | None = None) -> Column:
    """One test shell, or an inner and an outer one; the inner radius is radius * share ** (1 / dim) * 0.7.

    ``random`` takes the strategy from a coin in [0, 1), so it must be given one."""
    of = lambda a, b, s: F.struct(a.cast("double").alias("inner"), b.cast("double").alias("outer"), F.lit(s).alias("split"))
    zero = F.lit(0.0)
    if not enabled:
        return F.array(of(zero, radius, "test"))

    def two(share: float, first: str, second: str) -> Column:
        inner = radius * F.lit(share ** (1.0 / dim) * 0.7)
        return F.array(of(zero, inner, first), of(inner, radius, second))

    val, test = two(ratio, "validation", "test"), two(1.0 - ratio, "test", "validation")
    if strategy == "random":
        if coin is None:
            raise ValueError("a random strategy needs a coin")
        return F.when(coin < 0.5, val).otherwise(test)
    if strategy not in ("inner_val", "inner_test"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return val if strategy == "inner_val" else test


def checked(anchors: DataFrame) -> DataFrame:
    """Anchors whose shells don't overlap; others are an error when they are read."""
    bad = F.exists(F.arrays_zip(F.col("shells").alias("s"), F.slice("shells", 2, 1000).alias("t")), lambda p: p["s"]["outer"] > p["t"]["inner"])
    return anchors.withColumn("shells", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("shells overlap")).cast(SHELL)).otherwise(F.col("shells")))


def split_at(distance: Column, base: Column, buffer: Column, shells_: Column) -> Column:
    """The split of a point at a distance: train outside, unassigned in the buffer, else its shell's, else train."""
    inside = F.filter(shells_, lambda s: (s["inner"] <= distance) & (distance < s["outer"]))
    return (
        F.when(distance > base + buffer, F.lit("train"))
        .when(distance > base, F.lit("unassigned"))
        .otherwise(F.coalesce(F.try_element_at(inside, F.lit(1))["split"], F.lit("train")))
    )


def centers(anchors: DataFrame) -> DataFrame:
    return anchors.select(F.col("anchor_id").alias("id"), F.col("center").alias("v"))


def containing(p: DataFrame, anchors: DataFrame, metric: str = "cosine") -> DataFrame:
    """(id, anchor_id, d) for each anchor that a point lies in, its border included."""
    widest = anchors.agg(F.max(F.col("base_radius") + F.col("buffer_radius"))).first()[0]
    pairs = distances(p, centers(anchors), metric, within=-1.0 if widest is None else widest)
    radii = anchors.select(F.col("anchor_id").alias("r"), (F.col("base_radius") + F.col("buffer_radius")).alias("total"))
    return pairs.join(radii, "r").where("d <= total").select(F.col("l").alias("id"), F.col("r").alias("anchor_id"), "d")


def containing_lists(p: DataFrame, anchors: DataFrame, metric: str = "cosine") -> DataFrame:
    """(id, anchor_ids): ascending, empty for points in none."""
    found = containing(p, anchors, metric).groupBy("id").agg(F.array_sort(F.collect_list("anchor_id")).alias("anchor_ids"))
    return p.select("id").join(found, "id", "left").withColumn("anchor_ids", F.coalesce("anchor_ids", F.array().cast("array<bigint>")))


def assign(p: DataFrame, anchors: DataFrame, metric: str = "cosine", placed: bool = False) -> DataFrame:
    """(id, split, anchor_id, distance, n_containing): the first containing anchor decides, not the nearest.

    placed: anchors were placed one after another over p. A row in a border can still be taken then: the first anchor that has it
    within its base radius decides, else the last one whose border it is in."""
    met = containing(p, anchors, metric).join(anchors.drop("center"), "anchor_id")
    at = F.struct("anchor_id", "d", "base_radius", "buffer_radius", "shells")
    first, last = F.min_by(at, "anchor_id"), F.max_by(at, "anchor_id")
    if placed:
        first = F.coalesce(F.min_by(at, F.when(F.col("d") <= F.col("base_radius"), F.col("anchor_id"))), last)
    met = met.groupBy("id").agg(first.alias("m"), F.count(F.lit(1)).cast("int").alias("n_containing"))
    split = split_at(F.col("m.d"), F.col("m.base_radius"), F.col("m.buffer_radius"), F.col("m.shells"))
    met = met.select("id", split.alias("split"), "m.anchor_id", F.col("m.d").alias("distance"), "n_containing")
    return p.select("id").join(met, "id", "left").select(
        "id", F.coalesce("split", F.lit("train")).alias("split"), "anchor_id", "distance", F.coalesce("n_containing", F.lit(0)).alias("n_containing")
    )


def nearest_anchor(p: DataFrame, anchors: DataFrame, metric: str = "cosine") -> DataFrame:
    """(id, anchor_id, distance); without anchors an error."""
    if anchors.isEmpty():
        raise ValueError("no anchors")
    return distances(p, centers(anchors), metric, k=1).select(F.col("l").alias("id"), F.col("r").alias("anchor_id"), F.col("d").alias("distance"))


def placement_stats(p: DataFrame, anchors: DataFrame, metric: str = "cosine") -> DataFrame:
    """One row: anchors, share of points within a base radius, radii, and the least distance of two anchors (0 below two)."""
    inner = anchors.withColumn("buffer_radius", F.lit(0.0))
    covered = containing(p, inner, metric).select("id").distinct().agg(F.count(F.lit(1)).alias("c"))
    total = p.agg(F.count(F.lit(1)).alias("n"))
    c = centers(anchors)
    gap = distances(c, c, metric).where("l < r").agg(F.coalesce(F.min("d"), F.lit(0.0)).alias("min_separation"))
    radii = radius_stats(anchors)
    out = radii.join(total, how="cross").join(covered, how="cross").join(gap, how="cross")
    return out.withColumn("coverage_ratio", F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(F.lit(0.0))).drop("n", "c")


def radius_stats(anchors: DataFrame) -> DataFrame:
    r = "base_radius"
    return anchors.agg(
        F.count(F.lit(1)).alias("num_anchors"), F.coalesce(F.avg(r), F.lit(0.0)).alias("mean_radius"), F.coalesce(F.stddev_pop(r), F.lit(0.0)).alias("std_radius"),
        F.coalesce(F.min(r), F.lit(0.0)).alias("min_radius"), F.coalesce(F.max(r), F.lit(0.0)).alias("max_radius"),
    )


def anchor_kinds(anchors: DataFrame, p: DataFrame) -> DataFrame:
    """(anchor_id, kind): data_point if a point lies within 1e-6 of the centre, else synthetic."""
    near = distances(centers(anchors), p, "euclidean", k=1)
    kind = F.when(F.col("d") < 1e-6, F.lit("data_point")).otherwise(F.lit("synthetic"))
    return near.select(F.col("l").alias("anchor_id"), kind.alias("kind"))


def center_rows(assigned: DataFrame, p: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, id): the rows at an anchor's centre, by their distance, else every row within 1e-4."""
    own = assigned.where(F.col("distance") < 1e-4).select("anchor_id", "id")
    rest = anchors.join(own.select("anchor_id").distinct(), "anchor_id", "left_anti")
    found = distances(centers(rest), p, "euclidean", within=1e-4).where("d < 1e-4").select(F.col("l").alias("anchor_id"), F.col("r").alias("id"))
    return own.unionByName(found)
