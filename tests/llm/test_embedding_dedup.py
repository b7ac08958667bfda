"""Near-duplicate embeddings: recall and results against brute force, large groups, odd rows."""

import math

import duckdb
import numpy as np

from orbisplit.llm import embedding_dedup as ed
from orbisplit.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, ID string, W int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 1, 2) for i, v in rows], SCHEMA)


def brute(ids, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(1))
        if (new == label).all():
            return {i: (int(near[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids)}
        label = new


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def turned(rng, x, cos):
    """A vector at that cosine from each row."""
    o = rng.normal(size=x.shape)
    o -= (o * x).sum(1, keepdims=True) * x
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    return cos * x + math.sqrt(1 - cos * cos) * o


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    df = queries.QUERIES["op13_embedding_dedup"](spark, d)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL['op13_embedding_dedup']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(1)
    base = ed.unit(rng.normal(size=(2500, 64)))
    x = np.vstack([base, turned(rng, base, 0.905), ed.unit(rng.normal(size=(3000, 64)))]).astype(np.float32)
    found = got(ed.near_duplicates(frame(spark, list(enumerate(x)))))
    want = brute(range(len(x)), x.astype(float))
    links = sum(n for n, _, _ in want.values())
    assert links >= 4900 and sum(n for n, _, _ in found.values()) >= 0.99 * links
    assert all(found[i][0] <= want[i][0] for i in want)  # nothing below the threshold


def test_large_groups_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    c = ed.unit(rng.normal(size=(4, 64)))
    copies = np.repeat(c[:1], 400, 0)
    tight = ed.unit(c[1] + rng.normal(0, 0.02, (600, 64)))  # inside a ball
    loose = ed.unit(c[2] + rng.normal(0, 0.055, (300, 64)))  # around the threshold of each other
    chain = ed.unit(np.array([np.cos(a) * c[3] + np.sin(a) * c[0] for a in np.linspace(0.1, 3.0, 40)]))
    x = np.vstack([copies, tight, loose, chain, ed.unit(rng.normal(size=(200, 64)))]).astype(np.float32)
    ids = rng.permutation(len(x))
    df = frame(spark, list(zip(ids.tolist(), x, strict=True)))
    want = brute(ids.tolist(), x.astype(float))
    found = got(ed.near_duplicates(df))
    assert found == want
    reps = ed.distinct_vectors(df)[1]
    described = ed.describe(reps, ed.pivots_of(reps, reps.count()))
    assert described.where("ball >= 0").count() > 600  # nobody pairs these with each other
    # Lists cut into small blocks give the same.
    whole = {(r.id): r.n for r in ed.links(described).groupBy("id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    cut = {(r.id): r.n for r in ed.links(described, block=37).groupBy("id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert whole == cut


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [
        (1, a), (2, a), (3, [2.0, -0.0, 0.0]), (4, b), (5, None), (6, [0.0, 0.0, 0.0]), (7, []), (8, [1.0, None, 0.0]), (9, [float("nan"), 0.0, 0.0]),
        (10, [float("inf"), 0.0, 0.0]), (None, a), (11, [1.0]), (12, [1e30, 1e28, 0.0]), (13, [1e-40, 0.0, 0.0]), (14, b), (14, b),
    ]
    rows_out = ed.near_duplicates(frame(spark, rows)).collect()
    assert len(rows_out) == len(rows)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows_out}
    for i in (1, 2, 3, 11, 12, 13):
        assert found[i] == (5, 1, i == 1), i
    assert found[4] == (2, 4, True) and found[14][1:] == (4, False)
    for i in (5, 6, 7, 8, 9, 10):
        assert found[i] == (0, i, True)
    assert found[None] == (0, None, True)
    assert ed.near_duplicates(frame(spark, [])).collect() == []
    assert got(ed.near_duplicates(frame(spark, [(1, None)]))) == {1: (0, 1, True)}
