"""Bucketed order-sensitive operators against plain computations, with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ordered, profiling


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    group = np.where(rng.random(400) < 0.7, "hot", rng.choice(["a", "b", "c", "d"], 400))
    return pd.DataFrame({"g": group, "k": rng.permutation(400), "v": rng.integers(0, 50, 400) / 4.0})


def test_positions(spark, rows):
    found = ordered.positions(spark.createDataFrame(rows), ["g"], ["k"]).toPandas().sort_values("k")
    expected = rows.sort_values("k").groupby("g").cumcount() + 1
    assert found["pos"].tolist() == expected.tolist()
    everything = ordered.positions(spark.createDataFrame(rows), [], ["k"]).toPandas().sort_values("k")
    assert everything["pos"].tolist() == list(range(1, 401))


def test_quantiles(spark, rows):
    found = ordered.exact_quantiles(spark.createDataFrame(rows), ["g"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9, "hi": 1.0}).toPandas().set_index("g")
    for group, part in rows.groupby("g"):
        assert found.loc[group].tolist() == pytest.approx(part["v"].quantile([0.25, 0.5, 0.9, 1.0]).tolist())


def test_quantiles_of_one_repeated_value(spark):
    frame = spark.range(1000).select(F.lit("x").alias("g"), F.lit(2.5).alias("v"))
    assert ordered.exact_quantiles(frame, ["g"], "v", {"m": 0.5}).first().m == 2.5


@pytest.mark.parametrize("within", [[], ["g"]])
def test_rolling_mean(spark, rows, within):
    found = ordered.rolling_mean(spark.createDataFrame(rows), "v", within, ["k"], 5, "m").toPandas().sort_values("k")
    plain = rows.sort_values("k")
    values = plain.groupby("g")["v"] if within else plain["v"]
    expected = values.rolling(5).mean()
    expected = expected.reset_index(0, drop=True).reindex(plain.index) if within else expected
    np.testing.assert_allclose(found["m"].to_numpy(float), expected.to_numpy(float), equal_nan=True)
    assert len(found) == 400 and set(found.columns) == {"g", "k", "v", "m"}


def test_rolling_mean_over_tiny_buckets(spark):
    """Buckets smaller than the window: the rows before come from several of them."""
    frame = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("v"))
    found = [r.m for r in ordered.rolling_mean(frame, "v", [], ["k"], 5, "m").orderBy("k").collect()]
    assert found == [None] * 4 + [2.0, 3.0, 4.0]


def test_rolling_mean_does_not_cross_tickers(spark):
    frame = spark.createDataFrame([(t, i, 1.0) for t in "AB" for i in range(4)], "t string, k int, v double")
    assert all(r.m is None for r in ordered.rolling_mean(frame, "v", ["t"], ["k"], 5, "m").collect())
    crossing = ordered.rolling_mean(frame, "v", [], ["t", "k"], 5, "m").orderBy("t", "k").collect()
    assert [r.m for r in crossing] == [None] * 4 + [1.0] * 4


def test_rolling_mean_is_null_next_to_a_missing_value(spark):
    frame = spark.createDataFrame([(i, None if i == 1 else 1.0) for i in range(8)], "k int, v double")
    assert [r.m for r in ordered.rolling_mean(frame, "v", [], ["k"], 5, "m").orderBy("k").collect()] == [None] * 6 + [1.0] * 2


def test_summary_stats(spark, rows):
    found = profiling.summary_stats(spark.createDataFrame(rows)).toPandas().set_index("column_name")
    expected = rows[["k", "v"]].describe()
    for column in ("k", "v"):
        assert found.loc[column, ["n", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float).tolist() == pytest.approx(expected[column].tolist())


@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_rolling_mean_over_short_and_empty_buckets(spark, monkeypatch, size):
    """One row a bucket and gaps between buckets: tails come from many of them."""
    frame = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * F.col("id") * 1.0).alias("v"))
    rows = frame.withColumn(ordered.BUCKET, F.when(F.col("k") < 20, F.col("k") * 2).otherwise(45).cast("int"))
    monkeypatch.setattr(ordered, "_bucketed", lambda df, keys: rows)
    found = [r.m for r in ordered.rolling_mean(frame, "v", [], ["k"], size, "m").orderBy("k").collect()]
    expected = pd.Series([i * i * 1.0 for i in range(40)]).rolling(size).mean()
    np.testing.assert_allclose(np.array(found, float), expected.to_numpy(float), equal_nan=True)


def test_rolling_mean_walks_in_no_single_task(spark, rows):
    plan = ordered.rolling_mean(spark.createDataFrame(rows), "v", ["g"], ["k"], 5, "m")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
