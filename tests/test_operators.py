"""Golden values, boundaries and greedy scans of the vector operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisplit.config import Config, Placement, Spheres, from_dict
from orbisplit.functions import encoders, vectors
from orbisplit.operators import dedup, density, pairs, placement, quantiles, report, sampling, spheres

ANGLES = [0, 10, 30, 60, 100]


@pytest.fixture(scope="module")
def c5(spark):
    rows = [(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in enumerate(ANGLES)]
    return spark.createDataFrame(rows, "id long, v array<double>").cache()


def values(df, key, value):
    return {r[key]: round(r[value], 6) for r in df.collect()}


def test_distances_of_five_vectors(c5):
    got = {(r.l, r.r): round(r.d, 6) for r in pairs.self_pairs(c5).collect()}
    assert [got[0, j] for j in range(1, 5)] == [0.015192, 0.133975, 0.5, 1.173648]
    assert [got[1, 2], got[1, 3], got[1, 4], got[2, 3], got[2, 4], got[3, 4]] == [0.060307, 0.357212, 1.0, 0.133975, 0.65798, 0.233956]
    assert [round(x, 6) for x in quantiles.exact_quantiles(pairs.self_pairs(c5), {"d": [0.25, 0.5, 0.75]})["d"]] == [0.133975, 0.295584, 0.618485]


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_kernels_equal_expressions(spark, c5, metric):
    other = c5.select(F.col("id").alias("r"), F.col("v").alias("w"))
    want = {(r.id, r.r): r.d for r in c5.crossJoin(other).select("id", "r", vectors.distance(F.col("v"), F.col("w"), metric).alias("d")).collect()}
    got = {(r.l, r.r): r.d for r in pairs.distances(c5, c5, metric).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)
    with pytest.raises(ValueError):
        pairs.distances(c5, c5, "other")
    with pytest.raises(ValueError):
        vectors.distance(F.col("v"), F.col("v"), "other")


def test_blocks_without_broadcast_change_nothing(c5, monkeypatch):
    want = sorted(tuple(r) for r in pairs.knn(c5, 2).collect())
    monkeypatch.setattr(pairs, "BLOCK", 2)
    monkeypatch.setattr(pairs, "BROADCAST", 0)
    assert sorted(tuple(r) for r in pairs.knn(c5, 2).collect()) == want


def test_density_and_dimensionality(spark, c5):
    assert list(values(density.local_density(c5, 2), "id", "density").values()) == [13.407804, 26.49019, 10.294315, 5.435814, 2.242315]
    got = values(density.lid(c5, 4), "id", "lid")
    assert [got[i] for i in range(5)] == [0.407024, 0.373846, 0.538332, 1.243414, 1.275751]
    one = c5.where("id = 0")
    assert values(density.local_density(one), "id", "density") == {0: 1.0} and values(density.lid(one), "id", "lid") == {0: 1.0}


def test_number_of_anchors(spark):
    want = {1: 1, 2: 1, 10: 1, 50: 2, 100: 2, 500: 6, 1000: 13, 2000: 26, 10000: 133}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    assert {r.n: r.a for r in df.select("n", placement.num_anchors(F.col("n"), 0.2).alias("a")).collect()} == want
    assert {n: placement.anchors_for(n, 0.2) for n in want} == want


def test_shells(spark):
    for dim, share, factor in ((64, 0.5, 0.692460), (64, 0.3, 0.686955), (512, 0.5, 0.699053), (512, 0.3, 0.698356)):
        r = spark.range(1).select(spheres.shells(F.lit(1.0), dim, "inner_val", share).alias("s")).first().s
        assert round(r[0].outer, 6) == factor and [x.split for x in r] == ["validation", "test"]
    off = spark.range(1).select(spheres.shells(F.lit(1.0), 8, enabled=False).alias("s")).first().s
    assert [tuple(x) for x in off] == [(0.0, 1.0, "test")]
    with pytest.raises(ValueError):
        spheres.shells(F.lit(1.0), 8, "random")
    with pytest.raises(ValueError):
        spheres.shells(F.lit(1.0), 8, "other")


def test_borders(spark):
    s = F.array(F.struct(F.lit(0.0).alias("inner"), F.lit(0.3).alias("outer"), F.lit("validation").alias("split")), F.struct(F.lit(0.3).alias("inner"), F.lit(0.5).alias("outer"), F.lit("test").alias("split")))
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.5, 0.55, 0.6, 0.6000001)], "d double")
    got = [r.s for r in df.select(spheres.split_at(F.col("d"), F.lit(0.5), F.lit(0.1), s).alias("s")).collect()]
    assert got == ["validation", "test", "train", "unassigned", "unassigned", "train"]
    bad = spark.createDataFrame([([(0.0, 0.4, "test"), (0.3, 0.5, "test")],)], f"shells {spheres.SHELL}")
    with pytest.raises(Exception, match="overlap"):
        spheres.checked(bad).collect()


def anchor_rows(spark, rows):
    return spark.createDataFrame([(i, c, r, 0.0, [(0.0, r, "test")]) for i, c, r in rows], spheres.ANCHOR)


def test_first_match_not_nearest(spark, c5):
    a = anchor_rows(spark, [(0, [1.0, 0.0], 0.2), (1, [float(np.cos(np.radians(30))), 0.5], 0.2)])
    got = {r.id: (r.anchor_id, r.n_containing) for r in spheres.assign(c5, a).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 2), 3: (1, 1), 4: (None, 0)}
    assert {r.id: r.anchor_id for r in spheres.nearest_anchor(c5, a).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
    assert {r.id: r.anchor_ids for r in spheres.containing_lists(c5, a).collect()}[4] == []
    with pytest.raises(ValueError):
        spheres.nearest_anchor(c5, a.limit(0))
    assert spheres.assign(c5, a.limit(0)).where("split <> 'train' or anchor_id is not null").isEmpty()


@pytest.mark.parametrize("near, want", [(0.6, 0.5), (0.5, 0.25), (0.2, 0.125), (0.04, 0.03125), (0.03, None)])
def test_valid_radius(spark, near, want):
    assert spark.range(1).select(placement.valid_radius(F.lit(0.5), F.lit(near), 0.01).alias("r")).first().r == want


def test_eval_cap():
    d = np.arange(1, 11) * 0.05
    r = placement.capped_radius(d, 0.51, 4, 0.01)
    assert abs(r - 0.244375) < 1e-9 and (d < r).sum() == 4
    assert placement.capped_radius(d, 0.2, 4, 0.01) == 0.2


def test_eval_deficit():
    c = Config()
    assert placement.eval_deficit(80, 20, 50, 2, c) == 8
    assert placement.eval_deficit(70, 30, 20, 0, c) == 1
    assert placement.eval_deficit(70, 30, 20, 0, c, unassigned=0) == -6


def test_leaders_are_not_components(spark):
    v = [[1.0, 0.0], [float(np.cos(0.3)), float(np.sin(0.3))], [float(np.cos(0.6)), float(np.sin(0.6))]]
    p = spark.createDataFrame([(i, x, label) for i, (x, label) in enumerate(zip(v, [None, "x", "x"], strict=True))], "id long, v array<double>, label string")
    assert [r.id for r in dedup.leader_dedup(p, 0.9).orderBy("id").collect()] == [0, 2]
    labels = p.withColumn("label", F.expr("case id when 0 then 'X' when 1 then 'x' else 'x' end"))
    assert [r.id for r in dedup.leader_dedup(labels, 0.9, class_aware=True).orderBy("id").collect()] == [0, 1]


@pytest.mark.parametrize("metric, threshold", [("cosine", 0.3), ("euclidean", 0.45)])
def test_leaders_equal_a_sequential_scan(spark, metric, threshold):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 4))
    d = pairs.matrix(x, x, metric)
    sim = 1 - d if metric == "cosine" else 1 / (1 + d)
    kept: list[int] = []
    for i in range(len(x)):
        if all(sim[i, j] <= threshold for j in kept):
            kept.append(i)
    got = dedup.leader_dedup(sampling.as_points(spark, x).withColumn("label", F.lit(None).cast("string")), threshold, metric)
    assert sorted(r.id for r in got.collect()) == kept


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.999, 1.0])
def test_exact_quantile(spark, share):
    x = np.random.default_rng(4).standard_normal(501)
    df = spark.createDataFrame([(float(v),) for v in x], "d double")
    for bins in (3, 4096):
        assert abs(placement.exact_quantile(df, "d", share, bins) - np.quantile(x, share)) < 1e-12
    assert placement.exact_quantile(df.limit(1), "d", share) == df.first().d


def test_dense_runs(spark):
    df = spark.createDataFrame(list(enumerate([0.0, 9.0, 9.0, 0.0, 9.0])), "id long, density double")
    assert sorted((r.run_start, r.run_end) for r in density.dense_runs(df, 1.0).collect()) == [(1, 2), (4, 4)]


def test_farthest_points(spark):
    far = lambda x, n: [r.id for r in sampling.farthest_points(sampling.as_points(spark, np.array(x, float)).repartition(3), n).orderBy("place").collect()]
    x = [(0, 0), (1, 0), (0, 1), (5, 5), (6, 5)]
    assert far(x, 3) == [4, 0, 1] and far(x, 9) == [0, 1, 2, 3, 4]
    assert far([(1, 1)] * 5, 3) == [0, 1, 2]  # copies are taken once each
    assert far([(0, 0), (0, 0), (9, 9), (9, 9)], 3) == [0, 2, 1]
    assert sampling.farthest_points(spark.createDataFrame([], "id long, v array<double>"), 2).isEmpty()


def one_by_one(n, dim, seed, bits=30):
    """The sequence by its definition: each point from the one before."""
    v, shift = sampling.directions(dim, seed, bits)
    out, x = np.zeros((n, dim)), shift.copy()
    for i in range(n):
        out[i] = x / (1 << bits)
        x ^= v[:, (~i & (i + 1)).bit_length() - 1]
    return out


def test_sequences_fill_the_box(spark):
    index = np.arange(256)
    for make in (sampling.sobol_at, sampling.halton_at):
        x = make(index, 6)
        assert x.shape == (256, 6) and ((x >= 0) & (x < 1)).all()
        cells = np.histogramdd(x[:, :2], bins=8, range=[(0, 1)] * 2)[0]
        assert cells.min() >= 1 and cells.max() <= 9
        assert (make(index[200:], 6) == x[200:]).all()
    base = sampling.sobol_at(np.arange(64), 4)
    for d in range(4):
        assert sorted(np.floor(base[:, d] * 64).astype(int)) == list(range(64))
    assert (sampling.sobol_at(np.arange(500), 20, 7) == one_by_one(500, 20, 7)).all()
    assert [bin(p) for p in sampling.primitive_polynomials(4)] == ["0b11", "0b111", "0b1011", "0b1101"]
    low, high = np.array([-1.0, 5.0]), np.array([1.0, 9.0])
    for kind, unit in (("sobol", sampling.sobol_at(np.arange(90), 2)), ("halton", sampling.halton_at(np.arange(90), 2)), ("random", np.array([[sampling.u(42, i, d) for d in range(2)] for i in range(90)]))):
        got = np.array([r.v for r in sampling.points_in_box(spark, kind, 90, low, high).orderBy("id").collect()])
        assert np.abs(got - (low + unit * (high - low))).max() < 1e-12


@pytest.mark.parametrize("few", [4, 2048])
def test_many_quantiles_at_once(spark, few):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=3000), np.round(rng.exponential(size=3000), 1)
    df = spark.createDataFrame([(float(a), float(b), None, 2.5) for a, b in zip(x, y, strict=True)], "x double, y double, n double, same double").repartition(4)
    shares = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = quantiles.exact_quantiles(df, {"x": shares, "y": shares, "n": [0.5], "same": [0.3]}, 16, few)
    assert np.abs(np.array(got["x"]) - np.quantile(x, shares)).max() < 1e-12 and np.abs(np.array(got["y"]) - np.quantile(y, shares)).max() < 1e-12
    assert np.isnan(got["n"][0]) and got["same"] == [2.5]
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (1e308,), (-1e308,)], "x double")
    low, middle, high = quantiles.exact_quantiles(odd, {"x": [0.0, 0.5, 1.0]}, 4, few)["x"]
    assert (low, middle) == (-1e308, 2.0) and np.isnan(high)


def test_kmeans_keeps_the_best_of_its_starts(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, (40, 2)) for c in ((0, 0), (4, 0), (0, 4), (4, 4), (2, 2))])
    p = sampling.as_points(spark, x).repartition(3)
    inertia = lambda c: (pairs.matrix(x, np.array(c), "euclidean").min(1) ** 2).sum()
    of = lambda **more: [r.v for r in placement.kmeans_centers(p, 5, **more).collect()]
    best = of()
    assert np.allclose(best, sorted(x[i * 40 : i * 40 + 40].mean(0).tolist() for i in range(5)), atol=1e-6)
    assert inertia(best) <= min(inertia(of(starts=1, seed=s)) for s in range(3)) + 1e-9
    assert len(of(starts=2)) == 5 and placement.kmeans_centers(p.limit(0), 3).isEmpty()


def test_hashed_uniforms_are_the_same_everywhere(spark):
    got = spark.range(5).select(vectors.uniform(42, F.col("id")).alias("u")).collect()
    assert [r.u for r in got] == [sampling.u(42, i) for i in range(5)]


def test_whitening_and_projection(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0.2, 0.5]]) + 7
    p = sampling.as_points(spark, x)
    w = np.array([r.v for r in density.whiten(p).orderBy("id").collect()])
    assert np.allclose(np.cov(w.T), np.eye(3), atol=1e-6) and np.allclose(w.mean(0), 0, atol=1e-9)
    pc = np.array([r.pc for r in density.pca(p, 2).orderBy("id").collect()])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose((pc**2).sum(0), s[:2] ** 2)


def test_adaptive_radius_methods(spark, c5):
    c = c5.where("id = 1")
    got = {m: density.adaptive_radius(c, c5, 0.3, m, 0.0, 9.0).first().radius for m in ("kNN", "density", "LID", "none")}
    assert got["none"] == 0.3 and abs(got["kNN"] - np.mean([0.015192, 0.060307, 0.357212, 1.0])) < 1e-5
    assert 0.0375 <= got["LID"] <= 0.75 and got["density"] > 0


def test_closed_loop_respects_the_quota(spark, sf_dir):
    p = pairs.points(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    config = Config(spheres=Spheres(max_radius=0.8, percentile=20.0), placement=Placement(min_distance=0.3))
    train = p.where("id < 20")
    rest = p.where("id >= 20")
    placed = placement.closed_loop(rest, p, train, p.limit(0), 60, 500, config)
    rows = placed.collect()
    assert rows and all(0.01 <= r.radius <= 0.8 for r in rows)
    near = pairs.distances(placed.select("id", "v"), train).groupBy("l").agg(F.min("d").alias("m")).collect()
    radii = {r.id: r.radius for r in rows}
    assert all(r.m > radii[r.l] for r in near)
    a = spheres.assign(rest, placement.to_anchors(placed, config))
    evals = a.where("split in ('validation', 'test')").count()
    assert 1 < evals <= 60 + max(1, int(500 * 0.03))


def test_reports(spark):
    a = spark.createDataFrame([(1, "r", 0, "test"), (2, "r", 0, "train"), (3, "s", 0, "test"), (4, "s", None, "train")], "id long, run_id string, anchor_id long, split string")
    assert {r.id: r.similar for r in report.similar_members(a).collect()} == {1: "2,3", 2: "1,3", 3: "1,2", 4: ""}
    assert {r.id: r.similar for r in report.similar_members(a, 1).collect()}[1] == "2"
    s = report.statistics(a).first()
    assert (s.total_points, s.eval_ratio, s.num_anchors_used) == (4, 0.5, 1)
    assert report.statistics(a.limit(0)).first().eval_ratio == 0.0
    pts = spark.createDataFrame([("a", float(x), float(y)) for x in range(4) for y in range(4)], "g string, x double, y double").repartition(3)
    assert {(r.x, r.y) for r in report.hulls(pts, ["g"]).collect()} == {(0, 0), (3, 0), (0, 3), (3, 3)}


def test_consensus(spark):
    rows = [(1, "a", [1.0, 0.0]), (1, "b", [0.8, 0.6]), (1, "c", [-1.0, 0.0]), (2, "a", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, model string, v array<double>")
    got = {r.id: [round(x, 6) for x in r.v] for r in encoders.consensus(df, "a", 0.5).collect()}
    assert got == {1: [0.9, 0.3], 2: [0.0, 0.0]}
    assert {r.id: r.agree for r in encoders.consensus_agree(df, 0.5).collect()} == {1: False, 2: True}
    assert encoders.consensus(df, "a", 0.5, "intersection").count() == 2
    x = encoders.normalise_pixels(np.full((1, 3, 1, 1), 0.5), "siglip-base")
    assert np.allclose(x, 0) and encoders.pixel_constants("clip") == encoders.PIXELS["other"]


def test_settings():
    given = {"spheres": {"max_radius": 0.7}, "seed": 3}
    c = from_dict(given)
    assert c.spheres.max_radius == 0.7 and given == {"spheres": {"max_radius": 0.7}, "seed": 3}
    assert c.digest() == from_dict(given).digest() != Config().digest()
    for bad in ({"splits": {"train": 0.9}}, {"spheres": {"min_radius": 0.6}}, {"unknown": 1}, {"splits": {"train": 1.0, "eval": 0.0}}):
        with pytest.raises(ValueError):
            from_dict(bad)


@pytest.mark.parametrize("collected", [10, 10**6])
def test_base_radius_is_exact_at_every_size(spark, monkeypatch, collected):
    monkeypatch.setattr(placement, "EXACT_QUANTILE", 5, raising=False)
    monkeypatch.setattr(placement, "COLLECTED", collected, raising=False)
    v = np.random.default_rng(3).standard_normal((60, 3))
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    config = Config(spheres=Spheres(percentile=33.3, radius_scale=1.0, min_radius=0.0001, max_radius=2.0))
    want = np.quantile(pairs.matrix(v, v, config.metric)[np.triu_indices(60, 1)], 0.333)
    assert abs(placement.base_radius(p, config) - want) < 1e-12
    same = spark.createDataFrame([(float(x),) for x in [0.5] * 40 + [0.5 + 1e-15] * 40 + [9.0]], "d double")
    assert placement.exact_quantile(same, "d", 0.2, 3) == 0.5


def test_center_rows_keep_all_copies(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 5e-5])], "id long, v array<double>")
    a = spark.createDataFrame([(7, [1.0, 0.0], 0.1, 0.0, [])], spheres.ANCHOR)
    none = spheres.assign(p, a).limit(0)
    assert sorted((r.anchor_id, r.id) for r in spheres.center_rows(none, p, a).collect()) == [(7, 1), (7, 2), (7, 4)]


def test_members_of_a_large_anchor_are_written_by_many_tasks(spark, monkeypatch):
    rows = [(5, 1), (5, 1), (17, 1), (-3, 1), (100, 2), (100, 2), (8, 3), (9, None)] + [(i, 7) for i in range(1000, 1400)]
    a = spark.createDataFrame(rows, "id long, anchor_id long").repartition(2)
    monkeypatch.setattr(report, "SHARE", 32, raising=False)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = report.similar_members(a).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    expected = sorted((i, ",".join(str(x) for x in sorted(j for j, c in rows if c == k and k is not None and j != i))) for i, k in rows)
    assert sorted((r.id, r.similar) for r in got) == expected
    assert len({r.task for r in got if r.id >= 1000}) >= 4
