"""Exact percentiles by narrowing ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import quantiles, stats

AT = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_a_million_values_of_one_group(spark):
    """Several rounds: distinct values far beyond what a task orders, most of them in one corner."""
    rows = spark.range(1_000_000).select(F.when(F.col("id") < 900_000, F.exp(F.col("id") / -50_000.0)).otherwise(F.col("id") * 1e6 + 0.5).alias("x"))
    got = quantiles.percentiles(rows, "x", AT, ordered=500)
    want = np.percentile(np.array(rows.toPandas()["x"]), [100 * p for p in AT])
    assert got.first().percentiles == pytest.approx(want.tolist(), rel=1e-12)
    assert "percentile(" not in plan_of(got)


def test_groups_ties_and_nulls(spark):
    r = np.random.default_rng(1)
    data = [("a", float(x)) for x in r.integers(0, 5, 3000)] + [("b", float(x)) for x in r.normal(size=2000)] + [(None, 7.0), ("c", None), ("d", 1.0), ("d", 2.0), ("a", None)]
    got = {x.g: x.percentiles for x in quantiles.percentiles(spark.createDataFrame(data, "g string, x double"), "x", AT, ["g"], ordered=3).collect()}
    own = {}
    for g, x in data:
        if x is not None:
            own.setdefault(g, []).append(x)
    assert got.keys() == own.keys() and all(got[g] == pytest.approx(np.percentile(v, [100 * p for p in AT]).tolist()) for g, v in own.items())


def test_merged_ranges_and_whole_numbers(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_BROADCAST", -1)
    rows = spark.range(5000).select((F.col("id") % 10).alias("g"), (F.col("id") * 7 % 997).alias("x"))
    got = {x.g: x.percentiles for x in quantiles.percentiles(rows, "x", AT, ["g"], ordered=4).collect()}
    for g, own in rows.toPandas().groupby("g"):
        assert got[g] == pytest.approx(np.percentile(own["x"], [100 * p for p in AT]).tolist())


def test_reports_without_values(spark):
    none = spark.createDataFrame([], "x long, g string")
    assert stats.summary(none, "x").first().median is None and stats.summary(none, "x", ["g"]).count() == 0
    assert [tuple(r) for r in stats.cap_threshold(none, "x", 90).collect()] == [(None,)]
    assert stats.summary(spark.createDataFrame([(None, "a")], "x long, g string"), "x", ["g"]).first().p99 is None
