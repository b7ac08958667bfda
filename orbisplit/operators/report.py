"""Counts, ratios and data products over assignments, and along trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbisplit.functions.vectors import folder_of_run, uniform
from orbisplit.operators.pairs import distances
from orbisplit.operators.scans import Scan
from orbisplit.sources.tables import materialise

#: Rows of an anchor that are written by one task for each time that its members are sent.
SHARE = 1024


def split_counts(a: DataFrame, split: str = "split") -> DataFrame:
    return a.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def statistics(a: DataFrame, split: str = "split") -> DataFrame:
    """One row: counts and ratios, 0 for an empty table."""
    s = F.col(split)
    n = F.count(F.lit(1))
    ratio = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    train, val, test = F.count_if(s == "train"), F.count_if(s.isin("validation", "val")), F.count_if(s == "test")
    return a.agg(
        n.alias("total_points"), train.alias("train_count"), val.alias("validation_count"), test.alias("test_count"), F.count_if(s == "unassigned").alias("unassigned_count"),
        ratio(train).alias("train_ratio"), ratio(val).alias("validation_ratio"), ratio(test).alias("test_ratio"), ratio(val + test).alias("eval_ratio"),
        ratio(n - train).alias("coverage_ratio"), F.countDistinct("anchor_id").alias("num_anchors_used"),
    )


def coverage(a: DataFrame) -> DataFrame:
    return a.agg(F.count_if((F.col("n_containing") > 0) | F.col("anchor_id").isNotNull()).alias("covered"), F.count(F.lit(1)).alias("n"))


def run_histogram(a: DataFrame, run: str = "run_id", split: str = "split") -> DataFrame:
    """(run, n, splits): rows of each run, and a map of its splits."""
    return a.groupBy(run, split).agg(F.count(F.lit(1)).alias("c")).groupBy(run).agg(
        F.sum("c").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(split, "c")))).alias("splits")
    )


def points_per_anchor(a: DataFrame) -> DataFrame:
    """One row that describes the number of points of anchors that have any."""
    c = a.where("anchor_id is not null").groupBy("anchor_id").agg(F.count(F.lit(1)).alias("c"))
    quarter = [F.expr(f"percentile(c, {q / 100})").alias(f"p{q}") for q in (25, 50, 75)]
    return c.agg(F.count(F.lit(1)).alias("anchors"), F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"), F.min("c").alias("low"), *quarter, F.max("c").alias("high"))


def mean_points_of_all(a: DataFrame, anchors: DataFrame) -> DataFrame:
    """The mean over all anchors, those without points too."""
    c = a.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("c"))
    return anchors.select("anchor_id").join(c, "anchor_id", "left").agg(F.avg(F.coalesce("c", F.lit(0))).alias("mean_points"))


def class_counts(a: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """(label, total, n_eval), labels in lower case."""
    return a.where(F.col(label).isNotNull()).groupBy(F.lower(F.col(label).cast("string")).alias("label")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(split).isin("validation", "val", "test")).alias("n_eval")
    )


def similar_members(a: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, similar): the other members of each row's anchor, ascending and comma-joined; empty if there are none.

    Members are one text an anchor, made once; a row's answer is that text without the row's own bytes, whose place is a running sum. Rows of an
    anchor are dealt over tasks by SHARE, each of which gets the text once: what is sent is that part of what is written. ``limit``
    keeps that many of the smallest, where a list of all would not fit a row."""
    own = F.col("id").cast("string")
    if limit is not None:
        lists = a.where("anchor_id is not null").groupBy("anchor_id").agg(F.slice(F.array_sort(F.collect_list("id")), 1, limit + 1).alias("m"))
        others = F.transform(F.filter("m", lambda x: x != F.col("id")), lambda x: x.cast("string"))
        return a.join(lists, "anchor_id", "left").select("id", F.coalesce(F.array_join(others, ","), F.lit("")).alias("similar"))
    among = F.col("anchor_id").isNotNull() & F.col("id").isNotNull()
    ids = a.where(among).groupBy("anchor_id", "id").agg(F.count(F.lit(1)).alias("n"))
    placed = Scan(ids.withColumn("size", (F.octet_length(own) + 1) * F.col("n")), ["anchor_id"], ["id"]).running({"upto": F.col("size")}).rows()
    piece = F.struct("id", F.array_join(F.array_repeat(own, F.col("n").cast("int")), ",").alias("text"))
    lists = placed.groupBy("anchor_id").agg(F.array_sort(F.collect_list(piece))["text"].alias("m"), F.ceil(F.sum("n") / SHARE).alias("parts"))
    lists = materialise(lists.select("anchor_id", "parts", F.array_join("m", ",").cast("binary").alias("text")), "similar")
    n = int(min(max(lists.agg(F.sum("parts")).first()[0] or 1, 1), 4096))
    rows = placed.join(lists.select("anchor_id", "parts"), "anchor_id").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    rows = rows.select("anchor_id", "part", "id", "size", "upto", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    texts = lists.select("anchor_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = rows.repartition(n, "anchor_id", "part").join(texts.repartition(n, "anchor_id", "part").hint("merge"), ["anchor_id", "part"])
    first = F.expr("substring(text, cast(size + 1 as int))")
    others = F.expr("concat(substring(text, 1, cast(upto - size - 1 as int)), substring(text, cast(upto as int)))")
    alone = a.where(~among).select("id", F.lit("").alias("similar"))
    return met.select("id", F.when(F.col("upto") == F.col("size"), first).otherwise(others).cast("string").alias("similar")).unionByName(alone)


def train_mask(a: DataFrame, split: str = "dataset_split") -> Column:
    """Whether a row trains: unknown, train or unassigned, in any case."""
    return F.lower(F.coalesce(F.col(split), F.lit("train"))).isin("train", "unassigned")


def ordered(df: DataFrame, run: str, *order: str) -> DataFrame:
    """Add ``place``, from 1, and ``position``, from 0 to 1, within each run. A long run is cut over many tasks, as in all of these."""
    placed = Scan(df, [run], order).number("place", "_n").rows()
    return placed.withColumn("position", (F.col("place") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_n")


def arc_length(df: DataFrame, run: str, order: list[str], coordinates: list[str]) -> DataFrame:
    """Add ``arc``: the length of the way from a run's first row."""
    s = Scan(df, [run], order).previous({f"_was_{c}": c for c in coordinates})
    step = F.sqrt(sum(((F.col(c) - F.col(f"_was_{c}")) ** 2 for c in coordinates), F.lit(0.0)))
    return s.running({"arc": step}).rows().drop(*[f"_was_{c}" for c in coordinates])


def at_fractions(df: DataFrame, run: str, order: list[str], step: float) -> DataFrame:
    """The rows of each run at the fractions 0, step, 2 * step … of its length."""
    placed = Scan(df, [run], order).number("_i", "_n").rows()
    count = int(1 / step + 1e-9)
    wanted = F.exists(F.sequence(F.lit(0), F.lit(count)), lambda k: F.floor(k * F.lit(step) * (F.col("_n") - 1) + 1e-9) == F.col("_i") - 1)
    return placed.where(wanted).drop("_n", "_i")


def first_seen(df: DataFrame, run: str, order: str) -> DataFrame:
    """(run, first): runs by their first row."""
    return df.groupBy(run).agg(F.min(order).alias("first"))


def nth_of_folder(df: DataFrame, folder: str, order: str) -> DataFrame:
    """Number the runs (or batches) of each folder in their order, from 1: the n-th batch of a folder is its n-th run."""
    return Scan(df, [folder], [order]).number("ordinal").rows()


def run_labels(runs: DataFrame) -> DataFrame:
    """(run_id, label) of runs (run_id, folder_path): the run's name without its stamp, or, where those are not unique, the part of its folder
    in which the folders differ. Runs are few: a row each."""
    name = folder_of_run(F.col("run_id"))
    parts = F.split(F.regexp_replace(F.coalesce("folder_path", "run_id"), r"\\", "/"), "/")
    rows = runs.select("run_id", name.alias("_name"), parts.alias("_p"), F.reverse(parts).alias("_q"))
    ends = rows.agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("_name").alias("_names"), F.min("_p").alias("_a"), F.max("_p").alias("_b"), F.min("_q").alias("_c"), F.max("_q").alias("_d"))
    # What the first and the last of some arrays begin with, all begin with.
    alike = lambda a, b: F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size(a)), lambda k: F.slice(a, 1, k) == F.slice(b, 1, k)), lambda x: x))
    front, back = alike("_a", "_b"), alike("_c", "_d")
    middle = F.array_join(F.slice("_p", front + 1, F.greatest(F.size("_p") - front - back, F.lit(0))), "/")
    label = F.when((F.col("_n") == F.col("_names")) | (middle == ""), F.col("_name")).otherwise(middle)
    return rows.join(F.broadcast(ends), how="cross").select("run_id", label.alias("label"))


def representatives(a: DataFrame, n: int) -> DataFrame:
    """The n rows of each anchor nearest to its centre."""
    by = Window.partitionBy("anchor_id").orderBy("distance", "id")
    return a.where("anchor_id is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float, by: str | None = None) -> DataFrame:
    """([by], bin, n, density): equal bins over [low, high], the last one closed."""
    place = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    c = df.where(F.col(column).between(low, high)).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys or [F.lit(0)]))
    return c.withColumn("density", F.col("n") / (total * ((high - low) / bins)))


def grid(df: DataFrame, size: int) -> DataFrame:
    """(gx, gy): size * size places."""
    return df.sparkSession.range(size * size).select((F.col("id") / size).cast("int").alias("gx"), (F.col("id") % size).cast("int").alias("gy"))


def _axis(place: Column, size: int, low: float, high: float) -> Column:
    return F.lit(low) + place * ((high - low) / (size - 1))


def heatmap(centers: DataFrame, size: int, low: tuple[float, float], high: tuple[float, float], least: float = 0.05) -> DataFrame:
    """(gx, gy, heat): the largest of the Gaussians around centres (cx, cy, sigma), null below ``least``. A centre is sent to the places where
    it reaches that much, and to no other."""
    reach = F.col("sigma") * float(np.sqrt(-2 * np.log(least)))

    def places(c: str, i: int) -> Column:
        step = (high[i] - low[i]) / (size - 1)
        first = F.greatest(F.floor((F.col(c) - reach - low[i]) / step) - 1, F.lit(0)).cast("int")
        last = F.least(F.ceil((F.col(c) + reach - low[i]) / step) + 1, F.lit(size - 1)).cast("int")
        return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))

    near = centers.where("sigma > 0").select("cx", "cy", "sigma", F.explode(places("cx", 0)).alias("gx"))
    near = near.select("cx", "cy", "sigma", "gx", F.explode(places("cy", 1)).alias("gy"))
    d2 = (_axis(F.col("gx"), size, low[0], high[0]) - F.col("cx")) ** 2 + (_axis(F.col("gy"), size, low[1], high[1]) - F.col("cy")) ** 2
    near = near.select("gx", "gy", F.exp(-d2 / (2 * F.col("sigma") ** 2)).alias("heat")).where(F.col("heat") >= least)
    return grid(centers, size).join(near.groupBy("gx", "gy").agg(F.max("heat").alias("heat")), ["gx", "gy"], "left")


#: Rows of an anchor below which points of its surface stand in for more; and a spread for anchors with one point or none, of the data's.
FULL, NARROW = 50, 0.05


def spread(rows: DataFrame, centers: DataFrame, surface: DataFrame, extent: float, full: int = FULL) -> DataFrame:
    """(anchor_id, cx, cy, sigma): the mean distance in the plane of an anchor's rows (anchor_id, x, y) to its centre (anchor_id, cx, cy). An
    anchor of fewer than ``full`` rows is filled up with points of its surface (anchor_id, i, x, y) in order of i; one with less than two
    points even so has a fixed share of the data's extent."""
    counted = centers.select("anchor_id").join(rows.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("_n")), "anchor_id", "left")
    more = surface.join(counted, "anchor_id").where(F.col("i") < F.lit(full) - F.coalesce("_n", F.lit(0)))
    points = rows.select("anchor_id", "x", "y").unionByName(more.select("anchor_id", "x", "y")).join(centers, "anchor_id")
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    means = points.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("_m"), F.avg(d).alias("_d"))
    return centers.join(means, "anchor_id", "left").select("anchor_id", "cx", "cy", F.when(F.col("_m") >= 2, F.col("_d")).otherwise(F.lit(NARROW * extent)).alias("sigma"))


def surface_points(anchors: DataFrame, n: int, seed: int = 42, volume: bool = False) -> DataFrame:
    """(anchor_id, i, v): n points at the cosine radius of each anchor (anchor_id, center, base_radius), or, for a volume, at uniform shares of it. They
    have the centre's length; directions and shares are drawn by hashes of (seed, anchor, point, axis), so that every engine draws the same."""
    u = lambda d: uniform(seed, F.col("anchor_id"), F.col("i"), d)
    normal = lambda d: F.sqrt(-2 * F.log(F.greatest(u(2 * d), F.lit(1e-12)))) * F.cos(2 * np.pi * u(2 * d + 1))
    each = anchors.select("anchor_id", "center", "base_radius", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    radius = F.col("base_radius") * (u(F.lit("share")) if volume else F.lit(1.0))
    drawn = each.select("anchor_id", "i", "center", radius.alias("radius"), F.transform(F.sequence(F.lit(0), F.size("center") - 1), normal).alias("o"))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c, o = np.vstack(b["center"]), np.vstack(b["o"])
                size = np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-8)
                unit = c / size
                o = o - unit * (o * unit).sum(1, keepdims=True)
                o /= np.maximum(np.linalg.norm(o, axis=1, keepdims=True), 1e-8)
                angle = np.arccos(np.clip(1 - b["radius"].to_numpy(), -1, 1))[:, None]
                yield pd.DataFrame({"anchor_id": b["anchor_id"], "i": b["i"], "v": list((np.cos(angle) * unit + np.sin(angle) * o) * size)})

    return drawn.mapInPandas(turn, "anchor_id long, i int, v array<double>")


def placed_centers(centers: DataFrame, rows: DataFrame) -> DataFrame:
    """(anchor_id, p): centres (anchor_id, v, p) where they have a projection, else where the row (id, v, p) nearest to them lies; ties by id."""
    lost = centers.where("p is null").select(F.col("anchor_id").alias("id"), "v")
    near = distances(lost, rows.where("p is not null").select("id", "v"), "euclidean", k=1)
    found = near.select(F.col("l").alias("anchor_id"), F.col("r").alias("id")).join(rows.select("id", "p"), "id").select("anchor_id", "p")
    return centers.where("p is not null").select("anchor_id", "p").unionByName(found)


def align(rows: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Rows (folder, run, place, …) with the vectors (folder, batch, place, v) of stored batches: the n-th batch of a folder, by name, belongs to the
    n-th run of that folder, by its first row, and the k-th row of a batch to the k-th row of its run. A row without a vector gets zeros.

    Both sides are numbered by scans that cut long folders and runs over many tasks; then it is one join on (folder, n, k)."""
    runs = Scan(rows.groupBy("folder", "run").agg(F.min("place").alias("_first")), ["folder"], ["_first", "run"]).number("_n").rows().drop("_first")
    batches = Scan(vectors.select("folder", "batch").distinct(), ["folder"], ["batch"]).number("_n").rows()
    left = Scan(rows.join(runs, ["folder", "run"]), ["folder", "run"], ["place"]).number("_k").rows()
    right = Scan(vectors.join(batches, ["folder", "batch"]), ["folder", "batch"], ["place"]).number("_k").rows().select("folder", "_n", "_k", "v")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return left.join(right, ["folder", "_n", "_k"], "left").withColumn("v", F.coalesce("v", zeros)).drop("_n", "_k")


def kde(points: DataFrame, size: int, low: tuple[float, float], high: tuple[float, float], width: float) -> DataFrame:
    """(gx, gy, density) of points (cx, cy): Gaussians of one width, summed in numpy over each batch, then over batches."""
    gx, gy = (np.linspace(low[i], high[i], size) for i in (0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((size, size)), 0
        for b in batches:
            ex, ey = (np.exp(-((g[:, None] - b[c].to_numpy()[None, :]) ** 2) / (2 * width**2)) for g, c in ((gx, "cx"), (gy, "cy")))
            total, n = total + ex @ ey.T, n + len(b)
        x, y = np.meshgrid(range(size), range(size), indexing="ij")
        yield pd.DataFrame({"gx": x.ravel(), "gy": y.ravel(), "s": total.ravel(), "n": n})

    parts = points.select("cx", "cy").mapInPandas(run, "gx int, gy int, s double, n long")
    return parts.groupBy("gx", "gy").agg((F.sum("s") / (F.sum("n") * (2 * np.pi * width**2))).alias("density"))


def hulls(points: DataFrame, by: list[str]) -> DataFrame:
    """(by…, place, x, y): corners of the convex hull of each group of more than two points.

    Groups are first thinned to the extremes in 64 directions and all that lie outside of their polygon, per task, by
    the hulls of parts: a hull of hulls is the hull."""

    def corners(g: pd.DataFrame) -> pd.DataFrame:
        pts = sorted({(float(x), float(y)) for x, y in zip(g["x"], g["y"], strict=True)})
        if len(pts) > 2:
            turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
            sides = []
            for run in (pts, pts[::-1]):
                side: list[tuple[float, float]] = []
                for p in run:
                    while len(side) > 1 and turn(side[-2], side[-1], p) <= 0:
                        side.pop()
                    side.append(p)
                sides += side[:-1]
            pts = sides
        return pd.DataFrame({**{c: [g[c].iloc[0]] * len(pts) for c in by}, "place": range(len(pts)), "x": [p[0] for p in pts], "y": [p[1] for p in pts]})

    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, place int, x double, y double"

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from (corners(g) for _, g in b.groupby(by, dropna=False))

    return points.select(*by, "x", "y").mapInPandas(parts, schema).groupBy(*by).applyInPandas(corners, schema)


def sphere_samples(anchors: DataFrame, n: int, seed: int = 42, volume: bool = False) -> DataFrame:
    """(anchor_id, i, v): points at an anchor's cosine radius, moved so that their mean is the centre; or, for a volume, at uniform shares of the
    radius, where they are."""
    points = surface_points(anchors, n, seed, volume)
    if volume:
        return points
    points = materialise(points, "samples")
    mean = points.select("anchor_id", F.posexplode("v").alias("_d", "_x")).groupBy("anchor_id", "_d").agg(F.avg("_x").alias("_x"))
    mean = mean.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda e: e["_x"]).alias("_mean"))  # one number an axis
    off = anchors.select("anchor_id", "center").join(mean, "anchor_id").select("anchor_id", F.zip_with("center", "_mean", lambda c, m: c - m).alias("_off"))
    return points.join(off, "anchor_id").select("anchor_id", "i", F.zip_with("v", "_off", lambda x, y: x + y).alias("v"))


def projected_radius(a: DataFrame) -> DataFrame:
    """(anchor_id, radius): mean distance in the plane of an anchor's rows (x, y) to its centre (cx, cy); two rows at least."""
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    return a.where("anchor_id is not null").groupBy("anchor_id").agg(F.count(F.lit(1)).alias("_n"), F.avg(d).alias("radius")).where("_n >= 2").drop("_n")


