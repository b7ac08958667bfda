"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its NEAREST closest pivots (reference vectors), nearest first: the beginning of its permutation. It stands
in the inverted list of each of them. Two vectors of one list are candidates if they share pivots enough (SHARED of their beginnings, or
one that is the nearest of either); candidates are verified by their cosine in doubles. A pair is looked at in one list only, the one
with the smallest number of those that both stand in.

Large groups stay linear. Equal vectors are one vector with a weight. Vectors within half the angle of the threshold of their nearest
pivot form that pivot's ball: any two of a ball are linked, by the triangle inequality, so their links are counted by the ball's weight and
nobody pairs them. A member of a ball stands only in its own list and in those it can reach others of. Lists are cut into blocks of BLOCK
rows by a hash; a block meets each block of its list in a task of its own, and sends on counts and the edges of a spanning
forest, not the pairs.

Pivots are a sample of at most PIVOTS vectors (4 times the root of how many there are), thinned until no two are closer than APART: many
copies of one thing are one pivot, in their middle. The sample decides which pairs are candidates and so costs and recall; every vector is indexed and every
link that is reported is verified. Recall against brute force is a test (at least 0.99 of pairs between 0.9 and 0.92).

Defined cases: a vector that is null, zero, or holds null, infinite or NaN components links with nothing. Shorter vectors count as if
filled up with zeros. Each row is a vector: rows repeated whole link with each other; rows of one id are one node of a component,
with the sum of their links. A row without an id links with nothing, has no component and is kept. An empty table gives an empty
result. Further columns of any name are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisplit.llm.common import materialise
from orbisplit.operators.components import components

THRESHOLD, NEAREST, SHARED = 0.9, 10, 2
#: Pivots at most (8 MB of 64 doubles), and the cosine from which two are one.
PIVOTS, APART = 1 << 14, 0.8
BLOCK, PAIRS = 2048, 1 << 16
#: What rounding may add to an angle.
ROUNDING = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, since squares of large or tiny components leave the range of doubles."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(c: pa.Array, n: int) -> np.ndarray:
    return np.asarray(c.flatten()).reshape(n, -1).astype(np.float64)


def distinct_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, h1, h2), nulls where a row links with nothing, and the different vectors (id, w, v, h1, h2): smallest id, rows, components."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    good = F.coalesce(F.col(key).isNotNull() & finite & F.exists(v, lambda c: c != 0), F.lit(False))
    named = df.select(F.col(key).cast("long").alias("vec_id"), F.when(good, v).alias("v"))
    # Zeros of either sign are equal, and hash alike.
    kind = df.schema[vector].dataType.elementType.simpleString()
    plain = F.transform("v", lambda c: F.when(c == 0, F.lit(0).cast(kind)).otherwise(c))
    width = named.agg(F.max(F.size("v"))).first()[0] or 0
    filled = F.concat(plain, F.array_repeat(F.lit(0).cast(kind), F.lit(max(width, 0)) - F.size("v")))
    full = named.withColumn("v", F.when(F.col("v").isNotNull(), filled))
    hashes = [F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(i), F.col("v"))).alias(f"h{i}") for i in (1, 2)]
    rows = full.select("vec_id", "v", *hashes)
    reps = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"), F.min("v").alias("v"))
    return rows.drop("v"), materialise(reps, "vectors")


def pivots_of(reps: DataFrame, n: int, most: int = PIVOTS) -> np.ndarray:
    """Unit vectors: those of a sample by hash that are not near to an earlier one, each moved to the middle of the ones it stands for."""
    size = min(most, max(16, 4 * math.isqrt(n)))
    rows = reps.select("v", F.xxhash64("h2", "h1").alias("o")).orderBy("o", "v").limit(size).collect()  # PIVOTS rows at most
    if not rows:
        return np.zeros((0, 0))
    x = unit(np.array([r.v for r in rows], np.float64))
    free = np.ones(len(x), bool)
    kept = []
    for i in range(len(x)):
        if free[i]:
            near = free & (x @ x[i] >= APART)
            kept.append(x[near].sum(0))
            free &= ~near
    return unit(np.array(kept))


def describe(reps: DataFrame, pivots: np.ndarray, threshold: float = THRESHOLD, nearest: int = NEAREST) -> DataFrame:
    """Add prefix (the nearest pivots, in order), lists (those it stands in, ascending), ball (-1: none) and near (angle to the nearest)."""
    k, reach = min(nearest, len(pivots)), math.acos(threshold)
    half = reach / 2 - ROUNDING
    shared = reps.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                cos = unit(_vectors(part.column("v"), part.num_rows)) @ shared.value.T
                top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                order = np.lexsort((top, -np.take_along_axis(cos, top, 1)), axis=1)
                top = np.take_along_axis(top, order, 1)
                angle = np.arccos(np.clip(np.take_along_axis(cos, top, 1), -1.0, 1.0))
                ball = np.where(angle[:, 0] <= half, top[:, 0], -1)
                # Outside a ball: every list. In one: its own, and where a member of another ball or a lone vector may be in reach.
                there = (ball < 0)[:, None] | (angle <= half + reach + 2 * ROUNDING)
                there[:, 0] = True
                lists = [np.sort(t[m]).tolist() for t, m in zip(top, there, strict=True)]
                columns = [part.column(c) for c in ("h1", "h2", "id", "w", "v")]
                more = [pa.array(list(top.astype(np.int32)), pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int32())), pa.array(ball.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *more], ["h1", "h2", "id", "w", "v", "prefix", "lists", "ball"])

    kind = reps.schema["v"].dataType.simpleString()
    return reps.select("h1", "h2", "id", "w", "v").mapInArrow(run, f"h1 long, h2 long, id long, w long, v {kind}, prefix array<int>, lists array<int>, ball int")


def _counts(a: list[np.ndarray], b: list[np.ndarray], skip: int) -> np.ndarray:
    """How many values each set of a shares with each of b, by the inverted lists of either side; skip is a value that doesn't count."""
    out = np.zeros((len(a), len(b)), np.int8)
    sides = []
    for sets in (a, b):
        values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        values, rows = values[order], rows[order]
        at, start = np.unique(values, return_index=True)
        sides.append(dict(zip(at.tolist(), np.split(rows, start[1:]), strict=True)) if len(at) else {})
    for value, left in sides[0].items():
        if value != skip and value in sides[1]:
            out[np.ix_(left, sides[1][value])] += 1
    return out


def _sets(c: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return np.split(np.asarray(c.flatten()), np.cumsum(np.asarray(c.value_lengths()))[:-1]) if len(c) else []


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(group: pa.Table, threshold: float, shared: int = SHARED) -> pa.Table:
    """Links of two blocks of one list: (id, n, to), the weight that an id links with here, and the smallest id it reaches here."""
    group = group.sort_by([("id", "ascending"), ("h1", "ascending"), ("h2", "ascending")])
    pivot, low, high = (group.column(c)[0].as_py() for c in ("pivot", "low", "high"))
    block, ball, w, ids = (np.asarray(group.column(c)) for c in ("block", "ball", "w", "id"))
    prefix, lists = (_sets(group.column(c)) for c in ("prefix", "lists"))
    x = unit(np.asarray(group.column("v").combine_chunks().flatten()).reshape(len(ids), -1).astype(np.float64))
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    pick = lambda sets, at: [sets[i] for i in at]
    enough = _counts(pick(prefix, left), pick(prefix, right), pivot) >= shared - 1  # both have this list's pivot
    nearest = np.array([p[0] == pivot for p in prefix])
    enough |= nearest[left][:, None] | nearest[right][None, :]
    smaller = [s[s < pivot] for s in lists]
    enough &= _counts(pick(smaller, left), pick(smaller, right), -1) == 0
    enough &= (ball[left][:, None] != ball[right][None, :]) | (ball[left] < 0)[:, None]
    if low == high:
        enough = np.triu(enough, 1)
    i, j = np.nonzero(enough)
    i, j = left[i], right[j]
    linked = np.zeros(len(i), bool)
    for s in range(0, len(i), PAIRS):
        linked[s : s + PAIRS] = np.einsum("ij,ij->i", x[i[s : s + PAIRS]], x[j[s : s + PAIRS]]) >= threshold
    i, j = i[linked], j[linked]
    n = np.bincount(i, w[j], len(ids)) + np.bincount(j, w[i], len(ids))
    out = np.flatnonzero(n)
    return pa.table({"id": ids[out], "n": n[out].astype(np.int64), "to": ids[_labels(len(ids), i, j)][out]})


def links(described: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n, to) of all pairs of blocks of all lists."""
    rows = described.select("h1", "h2", "id", "w", "v", "prefix", "lists", "ball", F.explode("lists").alias("pivot"))
    sizes = described.select(F.explode("lists").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sizes = materialise(sizes, "list-sizes")  # PIVOTS rows at most
    cut = rows.join(F.broadcast(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    return met.groupBy("pivot", "low", "high").applyInArrow(lambda g: verify(g, threshold), "id long, n long, to long")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, nearest: int = NEAREST, most: int = PIVOTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows, reps = distinct_vectors(df, key, vector)
    nothing = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    pivots = pivots_of(reps, reps.count(), most)
    if not len(pivots):
        return rows.select("vec_id", *nothing)
    described = materialise(describe(reps, pivots, threshold, nearest), "described")
    found = materialise(links(described, threshold), "links")
    balls = described.where("ball >= 0").groupBy("ball").agg(F.sum("w").alias("all"), F.min("id").alias("first"))
    inside = described.where("ball >= 0").select("id", "w", "ball").join(balls, "ball")
    edges = found.select("id", "to").unionByName(inside.select("id", F.col("first").alias("to"))).where("id <> to")
    label = components(edges, "id", "to")
    counted = found.select("id", "n").unionByName(inside.select("id", (F.col("all") - F.col("w")).alias("n"))).unionByName(described.select("id", (F.col("w") - 1).alias("n")))
    counted = counted.groupBy("id").agg(F.sum("n").cast("long").alias("n_links"))
    about = described.select("h1", "h2", "id").join(counted, "id").join(label.withColumnRenamed("node", "id"), "id", "left")
    about = about.select("h1", "h2", "n_links", F.coalesce("label", "id").alias("component_id"))
    joined = rows.join(about, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
