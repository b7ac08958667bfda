"""Rows without clusters, where cells rule nothing out: all blocks meet over tiles."""

import numpy as np
import pytest

from orbisplit.operators import blocks, cells, pairs
from orbisplit.operators.blocks import matrix

from tests.test_cells import frame, links

WITHIN = {"cosine": 0.8, "euclidean": 5.0, "manhattan": 18.0}


@pytest.fixture
def small(monkeypatch):
    """Many small tiles, and no row sent to cells."""
    for module in (blocks, pairs, cells):
        monkeypatch.setattr(module, "BROADCAST", 0)
    monkeypatch.setattr(pairs, "PLAIN", 0)
    monkeypatch.setattr(pairs, "BLOCK", 0)
    monkeypatch.setattr(blocks, "TILE_BLOCK", 40)
    monkeypatch.setattr(blocks.tiles, "__defaults__", ((3, 3), False, False))


def unclustered(n=500, width=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, width))
    x[7] = x[8]
    return x


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_close_pairs_without_clusters(spark, monkeypatch, small, metric):
    def none(*_, **__):
        raise AssertionError("a row is sent to nearly every cell")

    monkeypatch.setattr(cells, "visits", none)
    a, b, within = unclustered(), unclustered(300, seed=1), WITHIN[metric]
    labels = [None if i % 7 == 0 else f"c{i % 3}" for i in range(500)]
    alike = np.array([[p is None or q is None or p == q for q in labels] for p in labels])
    d = matrix(a, a, metric)
    for named in (False, True):
        found = links(pairs.self_pairs(frame(spark, a, labels), metric, within, labels=named))
        want = set(zip(*np.nonzero(np.triu((d <= within) & (alike | (not named)), 1)), strict=True))
        assert set(found) == want and len(want) > 1000
        assert max(abs(found[p] - d[p]) for p in want) < 1e-7
    d = matrix(a, b, metric)
    found = links(pairs.distances(frame(spark, a), frame(spark, b, first=5000), metric, within))
    assert set(found) == {(i, 5000 + j) for i, j in zip(*np.nonzero(d <= within), strict=True)}


def test_nearest_without_clusters(spark, small):
    x = unclustered()
    x[100:130] = x[100]  # ties
    c = cells.build(frame(spark, x), len(x), "cosine", cell=20)
    rows, met = cells.nearest_by_cells(frame(spark, x), c, 6, True)
    d = matrix(x, x, "cosine")
    np.fill_diagonal(d, np.inf)
    assert rows.groupBy("l").count().agg({"count": "max"}).first()[0] <= 6 * blocks.SIDES[1]  # k of each tile
    got = {(r.l, r["rank"]): (r.d, r.r) for r in pairs.nearest(rows, 6).collect()}
    for i in range(len(x)):
        assert [got[i, n + 1][0] for n in range(6)] == pytest.approx(np.sort(d[i])[:6].tolist(), abs=1e-9)
    # A row is sent to the tiles of its side, not to each block of the other one.
    sent = met.select("l_tile", "r_tile", "l_block").distinct().groupBy("l_block").count().agg({"count": "max"}).first()[0]
    assert sent <= blocks.SIDES[1]


def test_what_a_task_holds_is_bounded(spark, monkeypatch):
    """However many cells a row visits, blocks are sent on when HELD rows are held."""
    monkeypatch.setattr(cells, "HELD", 500)
    x = unclustered(600)
    c = cells.build(frame(spark, x), 600, "cosine", cell=4)
    route = lambda d, slack, odd, b: np.ones(d.shape, bool)
    sent = cells.visits(frame(spark, x).coalesce(1), c, route, {}, False).selectExpr("size(l_ids) AS n")
    assert sent.agg({"n": "sum"}).first()[0] == 600 * int((c.count > 0).sum())
    assert sent.agg({"n": "max"}).first()[0] < 100


def test_sums_of_absolute_differences_are_exact(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(70, 64)) * 1e4, rng.normal(size=(90, 64))
    for x, y in ((a, b), (b, b), (b * 1e300, b), (a * np.nan, b)):
        d = matrix(x, y, "manhattan")
        for within in (np.nanmin(d[d > 0]) if (d > 0).any() else 1.0, 70.0, 5.0e5):
            i, j, found = blocks.close(x, y, "manhattan", within)
            assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(d <= within), strict=True))
            assert (found == d[i, j]).all()


@pytest.mark.parametrize(("n", "m", "scale", "shift"), [(300, 700, 1.0, 0.0), (900, 256, 1e-3, 5.0), (400, 400, 1e6, -1e7), (260, 300, 0.0, 3.0)])
def test_sums_of_differences_in_whole_numbers_lose_no_pair(n, m, scale, shift, monkeypatch):
    rng = np.random.default_rng(n)
    a, b = (rng.normal(size=(c, 24)) * scale + shift for c in (n, m))
    b[:20] = a[:20] + rng.normal(size=(20, 24)) * scale * 1e-6
    d = blocks.matrix(a, b, "manhattan")
    calls = []
    whole = blocks._close_whole
    monkeypatch.setattr(blocks, "_close_whole", lambda *x: calls.append(1) or whole(*x))
    for within in (0.0, float(np.sort(d.ravel())[15]), float(np.quantile(d, 0.05)), float(d.max()), -1.0):
        i, j, near = blocks.close(a, b, "manhattan", within)
        x, y = np.nonzero(d <= within)
        order = np.lexsort((j, i))
        assert np.array_equal(i[order], x) and np.array_equal(j[order], y) and np.array_equal(near[order], d[x, y])
    assert len(calls) == 5


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
@pytest.mark.parametrize("low, high", [(0.0, 0.5), (0.7, 0.9), (0.9, 0.9), (0.0, 2.1), (3.0, 9.0)])
def test_a_band_counts_every_pair(metric, low, high):
    import pyarrow as pa

    a, b = unclustered(300, seed=1), unclustered(280, seed=2)
    a[3], a[4], b[5], b[6] = np.nan, 0.0, 1e200, b[7]
    for l_block, r_block, x, y in ((0, 1, a, b), (2, 2, a, a)):
        ids = [np.arange(len(x)), np.arange(len(y)) + 1000 * (l_block != r_block)]
        row = {"l_block": [l_block], "r_block": [r_block], "l_ids": [ids[0]], "r_ids": [ids[1]], "l_v": [x.ravel()], "r_v": [y.ravel()]}
        n, below, found = blocks.pair_band(pa.RecordBatch.from_pydict(row), 0, metric, low, high)
        with np.errstate(invalid="ignore", over="ignore"):
            d = matrix(x, y, metric)
        d = d[(ids[0][:, None] < ids[1][None, :]) & ~np.isnan(d)]
        assert (n, below, len(found)) == (len(d), (d < low).sum(), ((d >= low) & (d <= high)).sum())
        assert np.allclose(np.sort(found), np.sort(d[(d >= low) & (d <= high)]), atol=1e-12)
