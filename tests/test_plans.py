"""Shape of the plans: nothing collects a table in one task, nothing pairs tables without a key."""

import time

import pytest
from pyspark.sql import functions as F

from tickerloom.plans import queries
from tickerloom.plans.panel import labelled_rows, period_panel, written_label_rows
from tickerloom.plans.queries import QUERIES
from tickerloom.session import pin
from tickerloom.sources import studyviews as views

FOLDER = "/root/testdata/sf0.001"
CORE = [
    "weekly_bars", "direction", "news_lag_join", "clean_panel", "token_counts", "top_tokens", "hash_embedding", "size_class",
    "cost_adjusted_returns", "ticker_scores", "long_short_picks", "portfolio_weights", "portfolio_returns", "metrics_by_year",
    "best_model_by_company", "walk_forward_folds", "event_detail_join", "metric_grid",
]


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE)
def test_no_single_task_and_no_product(spark, name):
    text = plan(spark, name)
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_what_it_needs(spark):
    text = plan(spark, "market_cap_by_date")
    scan = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert "l_orderkey" not in scan.split("ReadSchema")[1] and "l_discount" not in scan.split("ReadSchema")[1]
    assert "PushedFilters: [IsNotNull(l_suppkey)]" in scan


def test_top_tokens_limit_rows_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "top_tokens")
    assert "WindowGroupLimit" in plan(spark, "long_short_picks")


def test_a_written_table_leaves_no_shuffle_behind(spark):
    def files():
        listed = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {name for name in listed if "shuffle_" in name}

    before = files()
    made = pin(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    for _ in range(50):  # the files are deleted in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and made.count() == 7


def test_written_rows_are_those_of_the_panel(spark):
    daily, linked = views.panel_daily(spark, FOLDER), views.news_linked(spark, FOLDER)
    news = linked.unionByName(linked.where("keydevid % 3 = 0")).withColumn("headline", F.when(F.col("keydevid") % 5 > 0, F.col("headline")))
    found = written_label_rows(daily, news, views.PERIODS)
    plain = labelled_rows(period_panel(daily, news, views.PERIODS))
    assert found.count() == plain.count() > 1000 and found.exceptAll(plain).isEmpty()


def test_documents_are_not_copied_for_their_vectors(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(queries, "pin", lambda df, label: labels.append(label) or pin(df, label))
    monkeypatch.setattr(queries.cooccurrence, "word_vectors", lambda df, *_, **__: df.selectExpr("text AS word", "array(1D) AS vector").limit(1))
    queries.QUERIES["cooccurrence_embedding"](spark, FOLDER)
    assert labels == ["word-vectors"]
