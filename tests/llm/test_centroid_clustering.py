"""Centroid clustering against SQL, against a plain loop, and in odd cases."""

import hashlib

import duckdb
import numpy as np
import pytest

from orbisplit.llm import centroid_clustering as cc
from orbisplit.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, X string, Cluster int"


def plain(rows, k, rounds, width):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for n in range(rounds + 1):
        at = [min(range(len(centroids)), key=lambda c, x=x: (far(x, centroids[c]), c)) for _, x in kept]
        if n < rounds:
            for c in range(len(centroids)):
                own = [x for (_, x), a in zip(kept, at, strict=True) if a == c]
                if own:
                    centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted((i if i is not None else -1, a, far(x, centroids[a])) for (i, x), a in zip(kept, at, strict=True))


def got(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    df = queries.QUERIES["op11_centroid_clustering"](spark, d)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL['op11_centroid_clustering']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    # A small grid: many equal distances and many copies; and tight groups, where bounds save work.
    grid = [(i, (rng.integers(-2, 3, 3) / 256).tolist()) for i in range(300)]
    tight = [(1000 + i, (rng.normal(0, 0.004, 3) + rng.choice([-1.0, 0.0, 1.0], 3)).astype(np.float32).tolist()) for i in range(300)]
    odd = [(5, None), (6, []), (7, [1.0, 2.0]), (8, [1.0, None, 2.0]), (9, [float("nan"), 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (11, [0.1, 0.2, 0.3]), (11, [0.1, 0.2, 0.3])]
    for rows in (grid, tight, grid + tight + odd, odd, odd[:6], []):
        rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
        df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)
        assert got(cc.report(df, k=7, rounds=4, width=3)) == plain(rows, 7, 4, 3)
    out_of_range = spark.createDataFrame([(1, [1e30, 0.0, 0.0], 0, "x", 1), (2, [1.0, 0.0, 0.0], 0, "x", 1)], SCHEMA)
    assert got(cc.report(out_of_range, k=7, rounds=4, width=3)) == [(2, 0, 0)]


def test_bounds_save_work_and_ball_is_inclusive(monkeypatch):
    rng = np.random.default_rng(0)
    centers = rng.integers(-5000, 5000, (20, 8))
    x = centers[rng.integers(0, 20, 4000)] + rng.integers(-20, 21, (4000, 8))
    start = cc.Search(centers)
    cluster, upper, lower = start.assign(x, np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros(4000))
    scanned = []
    monkeypatch.setattr(cc.Search, "_scan", lambda self, x, rows, ball, *a: scanned.append(int(ball.sum())))
    cc.Search(centers + 1, centers).assign(x, cluster, upper, lower)
    assert sum(scanned) < 4000  # of 80000
    monkeypatch.undo()
    # Two centroids as far on either side: the smaller number wins wherever the search starts.
    two = cc.Search(np.array([[10, 0], [-10, 0], [0, 10]]))
    for c in range(3):
        assert two.assign(np.array([[0, 0]]), np.array([c]), np.array([np.inf]), np.zeros(1))[0].tolist() == [0]
