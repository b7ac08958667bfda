"""The loops that place anchors against plain sequential versions, and the eval share that an ingest ends with."""

import dataclasses
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisplit.config import Config, Dedup, Placement, Spheres
from orbisplit.operators import dedup, placement, spheres
from orbisplit.operators.pairs import matrix
from orbisplit.plans import catalogue
from orbisplit.plans.engine import Engine
from orbisplit.sources.tables import shared_root

CONFIG = Config(spheres=Spheres(max_radius=0.8, percentile=20.0), placement=Placement(min_distance=0.3))


def labelled(spark, sf_dir, n):
    return catalogue.labelled(spark, sf_dir).where(F.col("id") < n)


def arrays(df):
    rows = df.orderBy("id").collect()
    return [r.id for r in rows], np.array([list(r.v) for r in rows]), rows


def shrunk(d, radius, allowed, low):
    count = lambda r: int((d < r).sum())
    if count(radius) <= allowed:
        return radius
    a, b = low, radius
    for _ in range(5):
        m = (a + b) / 2
        a, b = (m, b) if count(m) <= allowed else (a, m)
    return max(a, low)


def sequential(spark, p, config, target, total, stored=()):
    """Classes by their size, each with its own candidates, then all that is left; point by point. Returns {id: class or None: eval or not}."""
    ids, v, rows = arrays(p)
    label = {r.id: r.label.lower() if r.label else None for r in rows}
    none = p.select("id", "v").limit(0)
    overshoot = max(1, int(total * config.splits.tolerance))
    size, evals = {}, {}
    for c in [*label.values(), *(s for s, _ in stored)]:
        if c is not None:
            size[c] = size.get(c, 0) + 1
    for c in size:
        evals[c] = sum(1 for s, split in stored if s == c and split != "train")
    n_eval = sum(evals.values())
    want = {c: max(1, int(n * config.splits.eval)) for c, n in size.items()}
    base = placement.base_radius(p.select("id", "v"), config)
    split = dict.fromkeys(ids)
    centers = []

    def accept(center, radius, wanted):
        nonlocal n_eval
        d = matrix(np.array([center]), v, config.metric)[0]
        free = np.array([split[i] is None for i in ids])
        r = shrunk(d[free], radius, wanted + overshoot, config.spheres.min_radius)
        inside = [i for i, x, f in zip(ids, d, free, strict=True) if f and x < r]
        if len(inside) <= 1:
            return
        for i, x, f in zip(ids, d, free, strict=True):
            if f and x <= r:
                split[i] = "eval" if x < r else "train"
        for i in inside:
            n_eval += 1
            if label[i] is not None:
                evals[label[i]] = evals.get(label[i], 0) + 1
        centers.append(list(center))

    for c in sorted(size, key=lambda c: (size[c], c)):
        own = p.where(F.lower("label") == c).select("id", "v")
        n = own.count()
        if n < 5:
            continue
        made = placement.propose(own, none, config, max(3, int(n * 0.5) * 3), filtered=False)
        made = placement.with_radii(made, p.select("id", "v"), none, base, config).orderBy("id").collect()
        for r in made:
            if evals[c] >= int(0.8 * want[c]) or not (n_eval < target or evals[c] / want[c] < 0.5):
                break
            accept(r.v, r.radius, target - n_eval)
    rest = [i for i in ids if split[i] is None]
    if n_eval < target and rest:
        left = p.where(F.col("id").isin(rest)).select("id", "v")
        known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "id long, v array<double>")
        made = placement.propose(left, known, config)
        made = placement.with_radii(made, p.select("id", "v"), none, placement.base_radius(left, config), config).orderBy("id").collect()
        for r in made:
            if n_eval >= target:
                break
            accept(r.v, r.radius, target - n_eval)
    return split, evals, len(centers)


@pytest.mark.parametrize("stored", [tuple([("c1", "test")] * 9 + [("c1", "train")] * 4 + [("c3", "train")] * 30)])
def test_class_aware_loop_equals_a_sequential_one(spark, sf_dir, stored):
    p = labelled(spark, sf_dir, 70).withColumn("label", F.when(F.col("id") % 17 > 0, F.concat(F.lit("C"), (F.col("id") * F.col("id") % 7 % 4).cast("int"))))
    n, there = 70 + len(stored), sum(1 for _, s in stored if s != "train")
    want, evals, n_anchors = sequential(spark, p, CONFIG, int(n * 0.2), n, stored)
    past = spark.createDataFrame(list(stored) or [("", "")], "label string, split string").where(F.lit(bool(stored)))
    none = p.select("id", "v").limit(0)
    placed = placement.class_aware_loop(p, p.withColumn("split", F.lit("unassigned")), none, none, past, int(n * 0.2), there, n, CONFIG)
    got = spheres.assign(p.select("id", "v"), placement.to_anchors(placed, CONFIG), placed=True).collect()
    assert placed.count() == n_anchors > 0
    assert {r.id for r in got if r.split in ("validation", "test")} == {i for i, s in want.items() if s == "eval"}
    assert {r.id for r in got if r.anchor_id is None} == {i for i, s in want.items() if s is None}


@pytest.mark.parametrize("low, high", [(0, 150)])
def test_labelled_ingest_keeps_the_eval_share(spark, sf_dir, low, high):
    """Class-aware placement, as the settings have it, in spheres wide enough for these vectors."""
    config = Config(spheres=Spheres(max_radius=0.8))
    assert config.class_aware
    e = Engine(spark, f"{shared_root(spark)}/state-{uuid.uuid4().hex}", config)
    rows = catalogue.labelled(spark, sf_dir).where(F.col("id").between(low, high - 1))
    e.ingest(rows, "one")
    s = e.statistics().first()
    assert s.total_points == high - low and 0 < s.eval_ratio <= config.splits.eval + config.splits.tolerance


@pytest.mark.parametrize("method", ["qmc", "random", "kmeans"])
def test_stand_alone_placement_keeps_its_spacing(spark, method):
    v = np.random.default_rng(8).standard_normal((50, 3))
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    config = Config(metric="euclidean", placement=Placement(method=method, min_distance=0.2, snap="nearest"))
    first = placement.place(p, config, 6)
    got = np.array([r.v for r in first.collect()])
    assert 1 <= len(got) <= 6 and (method == "qmc" or matrix(got, got, "euclidean")[np.triu_indices(len(got), 1)].min() >= 0.2)
    if method == "qmc":
        assert all(min(np.abs(v - x).max(1)) == 0 for x in got)
        more = placement.place_more(p, first, 0.5, config).collect()
        assert more and matrix(np.array([r.v for r in more]), got, "euclidean").min() >= 0.2


def test_rows_in_a_border_can_be_taken_later(spark):
    p = spark.createDataFrame([(1, [1.0]), (2, [1.35]), (3, [1.55]), (4, [9.0])], "id long, v array<double>")
    shells = "array(struct(0D as inner, base_radius as outer, 'test' as split))"
    rows = [(0, [1.0], 0.3, 0.1), (1, [1.3], 0.2, 0.3)]
    a = spark.createDataFrame(rows, "anchor_id long, center array<double>, base_radius double, buffer_radius double").withColumn("shells", F.expr(shells))
    got = {r.id: (r.split, r.anchor_id, r.n_containing) for r in spheres.assign(p, a, "euclidean", placed=True).collect()}
    assert got == {1: ("test", 0, 2), 2: ("test", 1, 2), 3: ("unassigned", 1, 1), 4: ("train", None, 0)}
    assert {r.id: r.split for r in spheres.assign(p, a, "euclidean").collect()}[2] == "unassigned"


def test_stored_ids_that_repeat_keep_their_labels(spark):
    new = spark.createDataFrame([(0, [1.0, 0.0], "A"), (1, [0.0, 1.0], "A"), (2, [0.0, 1.0], None)], "id long, v array<double>, label string")
    stored = spark.createDataFrame([(5, [1.0, 0.0], "B"), (5, [0.0, 1.0], "A")], "id long, v array<double>, label string")
    assert [r.id for r in dedup.drop_known(new, stored, 0.95, class_aware=True).collect()] == [0]
    assert dedup.drop_known(new, stored, 0.95).isEmpty()


@pytest.mark.parametrize("scanned", [10**6, 10])
def test_a_long_chain_is_scanned_in_few_rounds(spark, monkeypatch, scanned):
    monkeypatch.setattr(dedup, "SCANNED", scanned)
    n = 40 if scanned == 10 else 10_000
    edges = [(i, i + 1) for i in range(n)] + [(20_000 + i, 20_000 + j) for i in range(6) for j in range(i + 1, 6)]
    made = []
    write = dedup.materialise
    monkeypatch.setattr(dedup, "materialise", lambda df, name: made.append(name) or write(df, name))
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), *range(20_000, 20_006)]], "id long")
    kept = sorted(r.id for r in dedup.first_of_each(spark.createDataFrame(edges, "a long, b long"), nodes).collect())
    assert kept == [*range(0, n + 1, 2), 20_000]
    assert scanned == 10 or len(made) < 20


def test_dedup_threshold_and_classes_in_an_ingest(spark):
    config = dataclasses.replace(CONFIG, dedup=Dedup(threshold=0.95))
    e = Engine(spark, f"{shared_root(spark)}/state-{uuid.uuid4().hex}", config)
    rows = [(i, [float(np.cos(i * 0.7)), float(np.sin(i * 0.7))], "ab"[i % 2]) for i in range(8)]
    first = spark.createDataFrame(rows, "id long, v array<double>, label string")
    assert e.ingest(first, "one").count() == 8
    other = first.withColumn("label", F.lit("z"))
    assert e.ingest(other, "two").count() == 8 and e.ingest(first, "three").count() == 0


@pytest.mark.parametrize("by_class, target", [(False, 90), (True, 60)])
def test_acceptance_in_rounds_equals_one_by_one(spark, monkeypatch, by_class, target):
    rng = np.random.default_rng(target)
    rows = [(i, x.tolist(), [None, "a", "b", "c"][rng.choice(4, p=[0.1, 0.5, 0.3, 0.1])]) for i, x in enumerate(rng.random((250, 2)))]
    p = spark.createDataFrame(rows, "id long, v array<double>, label string")
    config = Config(metric="euclidean")
    goals = {k: placement.Goal(c, n) for k, (c, n) in enumerate([("c", 8), ("b", 20), ("a", 30)])} if by_class else None
    spots = [((int(rng.integers(0, 3)) << placement.RANK if by_class else 0) + i, x.tolist(), float(r)) for i, (x, r) in enumerate(zip(rng.random((25, 2)), rng.uniform(0.04, 0.15, 25), strict=True))]
    c = spark.createDataFrame(spots, "id long, v array<double>, radius double")
    # Plainly: every candidate in turn over a dictionary of free rows.
    want, free, ledger = {}, {i: (np.array(v), label) for i, v, label in rows}, placement.Ledger(target, 0, 5, 0.005)
    for k, v, radius in sorted(spots):
        if goals and not goals[k >> placement.RANK].open(ledger) or not goals and ledger.full:
            continue
        near = sorted((float(np.linalg.norm(x - np.array(v))), i, label) for i, (x, label) in free.items() if np.linalg.norm(x - np.array(v)) <= radius)
        given = ledger.offer(np.array([d for d, _, _ in near]), np.array([x for _, _, x in near], object), radius)
        if given is not None:
            want[k] = round(given, 9)
            free = {i: x for i, x in free.items() if i not in {i for d, i, _ in near if d <= given}}
    rounds = []
    step = placement._round
    monkeypatch.setattr(placement, "_round", lambda *a: rounds.append(1) or step(*a))
    for scanned in (10**6, 60):
        own = placement.Ledger(target, 0, 5, 0.005)
        got = {r.id: round(r.radius, 9) for r in placement.settle(c, p, own, config, goals, scanned).collect()}
        assert got == want, scanned
        assert own.n_eval == ledger.n_eval and (not goals or own.by_class == ledger.by_class)
    assert len(want) > 3 and 0 < len(rounds) < len(spots)


def quantile_of(v, metric, share):
    return float(np.quantile(matrix(v, v, metric)[np.triu_indices(len(v), 1)], share))


@pytest.mark.parametrize("metric, guess, kept", [("cosine", (), 10**6), ("cosine", (1.9, 1.99), 50), ("cosine", None, 0), ("euclidean", (0.0, 1e-9), 10**6)])
def test_pair_quantile_is_exact_whatever_is_guessed(spark, monkeypatch, metric, guess, kept):
    v = np.random.default_rng(4).standard_normal((90, 3))
    v[5], v[6] = v[7], 0.0
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    monkeypatch.setattr(placement, "KEPT", kept)
    if guess != ():
        monkeypatch.setattr(placement, "_guess", lambda *a: guess)
    want = quantile_of(v, metric, 0.2)
    assert abs(placement.pair_quantile(p, metric, 0.2, bins=64) - want) < 1e-12
    # The quantile is beyond the bound only where a count says so, whatever is guessed.
    assert placement.pair_quantile(p, metric, 0.2, most=want + 1e-6, bins=64) == pytest.approx(want, abs=1e-12)


def test_a_radius_beyond_its_bounds_takes_one_pass(spark, monkeypatch):
    v = np.random.default_rng(5).standard_normal((200, 8))
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    config = dataclasses.replace(CONFIG, spheres=Spheres(max_radius=0.2, min_radius=0.1, percentile=50.0))
    passes, histogram = [], placement.pair_histogram
    monkeypatch.setattr(placement, "pair_histogram", lambda *a: passes.append(a) or histogram(*a))
    assert placement.base_radius(p, config) == 0.2 and len(passes) == 1
    config = dataclasses.replace(CONFIG, spheres=Spheres(max_radius=1.9, min_radius=1.8, percentile=50.0))
    assert placement.base_radius(p, config) == 1.8 and len(passes) == 2
    config = dataclasses.replace(CONFIG, spheres=Spheres(max_radius=1.9, min_radius=0.1, percentile=50.0))
    assert abs(placement.base_radius(p, config) - quantile_of(v, "cosine", 0.5)) < 1e-12


def test_what_has_nothing_to_meet_is_read_once(spark, sf_dir):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    p = labelled(spark, sf_dir, 30)
    p = p.mapInArrow(counted, p.schema)
    none = p.select("id", "v").limit(0)
    assert len(dedup.far_from(p, spark.createDataFrame([], none.schema), 0.3).collect()) == 30 and read.value == 30
    assert len(dedup.drop_known(p, spark.createDataFrame([], p.schema), 0.3).collect()) == 30 and read.value == 60
    c = p.select("id", "v", F.when(F.col("id") > 4, 0.5).alias("radius"))
    assert {r.radius for r in placement.validate(c, spark.createDataFrame([], none.schema), 0.1).collect()} == {0.5} and read.value == 90
