"""Acceptance by parts of the candidates, and dimensionality where it is asked for."""

import numpy as np
from pyspark.sql import functions as F

from orbisplit.config import Config
from orbisplit.operators import density, placement

from tests.test_cells import frame


def test_only_candidates_up_to_the_target_are_given_radii(spark, monkeypatch):
    monkeypatch.setattr(placement, "FIRST_OFFERED", 3)
    monkeypatch.setattr(placement, "MORE_OFFERED", 2)
    x = np.random.default_rng(1).normal(size=(120, 6))
    p = frame(spark, x, [f"c{i % 3}" for i in range(120)]).cache()
    c = p.where("id % 3 = 0").select("id", "v").cache()
    seen = []

    def radii(part):
        seen.append(part.count())
        return part.withColumn("radius", F.lit(0.35))

    ledger = lambda: placement.Ledger(30, 0, 4, 0.01)
    got = lambda d: sorted((r.id, r.radius) for r in d.collect())
    whole = got(placement.settle(c.withColumn("radius", F.lit(0.35)), p, ledger(), Config()))
    assert got(placement.settle_in_turn(c, radii, p, ledger(), Config())) == whole and len(whole) > 3
    assert sum(seen) < 40 and len(seen) > 1  # not all of them
    goals = {0: placement.Goal("c0", 10), 1: placement.Goal("c1", 10)}
    ranked = c.withColumn("id", F.shiftleft((F.col("id") % 2).cast("long"), placement.RANK) + F.col("id"))
    whole = got(placement.settle(ranked.withColumn("radius", F.lit(0.35)), p, ledger(), Config(), goals))
    assert got(placement.settle_in_turn(ranked, radii, p, ledger(), Config(), goals)) == whole and whole


def test_dimensionality_of_some_rows(spark):
    p = frame(spark, np.random.default_rng(2).normal(size=(90, 5))).cache()
    some = p.where("id % 4 = 1")
    every = {r.id: r.lid for r in density.lid(p).collect()}
    assert {r.id: round(r.lid, 9) for r in density.lid_at(some, p).collect()} == {i: round(every[i], 9) for i in range(1, 90, 4)}
