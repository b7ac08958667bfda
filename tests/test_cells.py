"""Joins by cells of a metric space against brute force, and how many blocks meet."""

import numpy as np
import pytest

from orbisplit.operators import cells, dedup, pairs
from orbisplit.operators.blocks import matrix

RADIUS = {"cosine": 0.02, "euclidean": 0.6, "manhattan": 2.0}


def clustered(seed=0, n=1200, groups=60, width=8, noise=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, width))
    return c[rng.integers(0, groups, n)] + rng.normal(0, noise, (n, width))


def frame(spark, x, labels=None, first=0):
    rows = [(first + i, [float(a) for a in v], *([labels[i]] if labels else [])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + ", label string" * bool(labels)).repartition(3)


def links(df):
    return {(r.l, r.r): r.d for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_close_pairs_equal_brute_force(spark, metric):
    a, b = clustered(), clustered(1, 700)
    b[:50] = a[:50]  # equal rows
    a[3], b[7], b[8] = 0.0, 0.0, 1e-12  # without a direction
    within = RADIUS[metric]
    c = cells.build(frame(spark, b, first=5000), len(b), metric, cell=20)
    d = matrix(a, b, metric)
    want = {(i, 5000 + j) for i, j in zip(*np.nonzero(d <= within), strict=True)}
    found = links(cells.close_pairs(frame(spark, a), c, within))
    assert set(found) == want and len(want) > 1000
    assert max(abs(found[i, j] - d[i, j - 5000]) for i, j in want) < 1e-7
    own = cells.build(frame(spark, a), len(a), metric, cell=20)
    d = matrix(a, a, metric)
    assert set(links(cells.close_self_pairs(own, within))) == set(zip(*np.nonzero(np.triu(d <= within, 1)), strict=True))


def test_labels_and_repeated_ids(spark):
    x = clustered(2, 400, 10)
    labels = [None if i % 7 == 0 else f"c{i % 3}" for i in range(400)]
    df = frame(spark, x, labels)
    c = cells.build(df, 400, "cosine", cell=20)
    d = matrix(x, x, "cosine")
    alike = np.array([[p is None or q is None or p == q for q in labels] for p in labels])
    want = set(zip(*np.nonzero(np.triu((d <= 0.02) & alike, 1)), strict=True))
    assert set(links(cells.close_self_pairs(c, 0.02, labels=True))) == want
    both = df.unionByName(df)
    assert cells.close_pairs(both, c, 0.02, other=True, labels=True).count() == 4 * len(want)


def test_cells_that_cannot_reach_each_other_never_meet(spark):
    x = clustered(3, 2000, 100, 16, 0.02)
    c = cells.build(frame(spark, x), 2000, "cosine", cell=20)
    met = cells.pairs_of_blocks(c.rows, c, 0.02, one_way=True).selectExpr("size(l_ids) * size(r_ids) AS n").agg({"n": "sum"}).first()[0]
    assert met < 2000 * 2000 / 2 / 20  # of the pairs of a plain join
    unclustered = np.random.default_rng(0).normal(size=(1000, 64))
    c = cells.build(frame(spark, unclustered), 1000, "cosine", cell=20)
    met = cells.pairs_of_blocks(c.rows, c, 0.02, one_way=True).selectExpr("size(l_ids) * size(r_ids) AS n").agg({"n": "sum"}).first()[0]
    assert met <= 1000 * 1000  # never more than all with all


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_nearest_equal_brute_force(spark, metric):
    a, b = clustered(4, 300), clustered(5, 900)
    b[:40] = a[:40]
    b[100:130] = b[100]  # ties
    a[3], b[7] = 0.0, 0.0
    c = cells.build(frame(spark, b), len(b), metric, cell=20)
    for left, right, k, other in ((a, b, 7, False), (b, b, 5, True)):
        rows, second = cells.nearest_by_cells(frame(spark, left), c, k, other)
        d = matrix(left, right, metric)
        if other:
            np.fill_diagonal(d, np.inf)
        got = {}
        for r in pairs.nearest(rows, k).collect():
            got.setdefault(r.l, {})[r.rank] = (r.d, r.r)
        for i in range(len(left)):
            assert [got[i][n + 1][0] for n in range(k)] == pytest.approx(np.sort(d[i])[:k].tolist(), abs=1e-6)
            assert len({got[i][n + 1][1] for n in range(k)}) == k
        assert rows.groupBy("l").count().where("count > 2000").isEmpty()
    met = second.selectExpr("size(l_ids) * size(r_ids) AS n").agg({"n": "sum"}).first()[0]
    assert met < 900 * 900 / 2


def test_fewer_rows_than_wanted_and_odd_rows(spark):
    x = clustered(6, 30, 3)
    x[5] = np.nan
    c = cells.build(frame(spark, x), 30, "euclidean", cell=4)
    rows, _ = cells.nearest_by_cells(frame(spark, x), c, 50, True)
    counts = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    assert 5 not in counts and set(counts.values()) == {28}
    assert cells.build(frame(spark, x).limit(0), 0, "cosine") is None


def test_operators_are_the_same_by_cells(spark, monkeypatch):
    x = clustered(7, 600, 30)
    df, stored = frame(spark, x, ["a", "b"] * 300), frame(spark, clustered(7, 200, 30), ["a", "b"] * 100, first=10_000)
    ids = lambda d: sorted(r.id for r in d.select("id").collect())
    run = lambda: (
        ids(dedup.drop_known(df, stored, 0.98)), ids(dedup.drop_known(df, stored, 0.98, class_aware=True)), ids(dedup.leader_dedup(df, 0.98)),
        ids(dedup.spacing_filter(df, 0.05)), ids(dedup.far_from(df, stored, 0.05)), ids(dedup.uncovered(df, stored, 0.1)), sorted(map(tuple, pairs.knn(df.select("id", "v"), 4).select("l", "r", "rank").collect())),
    )
    plain = run()
    monkeypatch.setattr(pairs, "PLAIN", 0)
    monkeypatch.setattr(pairs, "BROADCAST", 0)
    monkeypatch.setattr(cells, "BROADCAST", 0)
    monkeypatch.setattr(cells, "CELL", 20)
    monkeypatch.setattr(cells.build, "__defaults__", (20,))
    assert run() == plain
