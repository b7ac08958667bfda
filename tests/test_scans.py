"""Two-level scans against pandas, with a run that is cut over many tasks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbisplit.operators.scans import PIECE, Scan


@pytest.mark.parametrize("pieces", [1, 9])
def test_one_long_run_is_cut_and_scanned(spark, pieces):
    rows = [("long" if i % 10 else None if i % 20 else "short", (i * 7919) % 3000, float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(rows, "run string, at long, x double").repartition(5)
    s = Scan(df, ["run"], ["at"], pieces).number("place", "n").previous({"was": "x"})
    s = s.add({"step": F.abs(F.col("x") - F.col("was"))}).running({"way": F.col("step"), "upto": F.col("x")})
    if pieces > 1:
        assert s.df.where("run = 'long'").select(PIECE).distinct().count() > 5
    got = s.rows().toPandas().sort_values(["run", "at"], na_position="first").reset_index(drop=True)
    want = pd.DataFrame(rows, columns=["run", "at", "x"]).sort_values(["run", "at"], na_position="first").reset_index(drop=True)
    g = want.groupby("run", dropna=False)
    assert (got["place"] == g.cumcount() + 1).all() and (got["n"] == g["at"].transform("count")).all()
    was = g["x"].shift()
    assert got["was"].equals(was)
    want["step"] = (want["x"] - was).abs().fillna(0)
    g = want.groupby("run", dropna=False)
    assert got["way"].to_list() == pytest.approx(g["step"].cumsum().to_list())
    assert got["upto"].to_list() == pytest.approx(g["x"].cumsum().to_list())


def test_all_rows_as_one_group_and_none(spark):
    df = spark.range(1000).withColumn("v", F.lit(2))
    got = Scan(df, [], ["id"], 7).number("place").running({"s": F.col("v")}).rows().orderBy("id").collect()
    assert [(r.place, r.s) for r in got] == [(i + 1, 2 * (i + 1)) for i in range(1000)]
    assert Scan(df.limit(0), ["v"], ["id"]).number("place").previous({"w": "v"}).rows().collect() == []
