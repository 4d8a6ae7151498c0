"""Small literal frames for the rules that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import dates, nested, numbers, text
from tickerloom.operators import bars, cleaning, news, portfolio, profiling, returns, scores, tokens, universe
from tickerloom.params import GROSS, NET, Periods


def day(value):
    return dt.date.fromisoformat(value)


def daily(spark, rows):
    schema = "permco long, ticker string, date string, prc double, cfacpr double, ret double, rec_id long, rec_line int"
    return spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("date"))


def test_week_edges(spark):
    frame = spark.createDataFrame([("2024-01-04",), ("2024-01-05",), ("2024-01-06",), ("2024-01-07",)], "d string")
    frame = frame.select(dates.week_end(F.col("d").cast("date")).alias("f"), F.col("d"))
    found = {row.d: row.f.isoformat() for row in frame.collect()}
    assert found == {"2024-01-04": "2024-01-05", "2024-01-05": "2024-01-05", "2024-01-06": "2024-01-12", "2024-01-07": "2024-01-12"}


def test_total_loss_and_zero_factor(spark):
    rows = [(1, "A", "2024-01-03", 10.0, 2.0, 0.10, 1, 1), (1, "A", "2024-01-04", 5.0, 0.0, -1.0, 2, 1)]
    bar = bars.weekly_bars(daily(spark, rows)).first()
    assert bar.weekly_ret == pytest.approx(-100.0)
    assert bar.adj_prc is None
    assert (bar.start_date, bar.end_date) == (day("2024-01-01"), day("2024-01-05"))


def test_bar_without_tie_keys(spark):
    rows = [(1, "A", "2024-01-03", 10.0, 2.0, 0.10, 1, 1), (1, "A", "2024-01-04", 8.0, 2.0, 0.20, 2, 1)]
    bar = bars.weekly_bars(daily(spark, rows), order=()).first()
    assert (bar.adj_prc, round(bar.weekly_ret, 6)) == (4.0, 32.0)


def test_compound_of_nothing_is_zero(spark):
    frame = spark.createDataFrame([("a", None), ("a", None), ("b", 0.5)], "k string, r double")
    found = {r.k: r.c for r in frame.groupBy("k").agg(numbers.compound(F.col("r")).alias("c")).collect()}
    assert found == {"a": 0.0, "b": 0.5}


def test_first_bar_is_up_and_equal_price_is_up(spark):
    rows = [(1, "A", "2024-01-05", 3.0), (1, "A", "2024-01-12", 3.0), (1, "A", "2024-01-19", 2.0), (2, "B", "2024-01-05", 1.0)]
    frame = spark.createDataFrame(rows, "permco long, ticker string, end_date string, adj_prc double")
    found = [r.direction for r in bars.direction(frame).orderBy("permco", "end_date").collect()]
    assert found == ["Up", "Up", "Down", "Up"]


def test_periods_start_with_a_first_bar_of_their_own(spark):
    rows = [(1, "A", "2015-12-31", 9.0, 1.0, 0.0, 1, 1), (1, "A", "2016-01-01", 5.0, 1.0, 0.0, 2, 1)]
    tagged = bars.with_period(daily(spark, rows), Periods())
    found = bars.direction(bars.weekly_bars(tagged, ["period"]), ["period"]).collect()
    assert sorted((r.period, r.direction) for r in found) == [("estimation", "Up"), ("out_of_sample", "Up")]


def test_news_reaches_the_following_week_once_per_headline(spark):
    bar = spark.createDataFrame([(1, "2024-01-12"), (1, "2024-01-19"), (2, "2024-01-12")], "permco long, d string")
    bar = bar.select("permco", F.col("d").cast("date").alias("end_date"))
    # Saturday 2023-12-30 to Friday 2024-01-05 is the week before the one that ends on 2024-01-12.
    events = [(1, "2023-12-30", "first"), (1, "2024-01-05", "last"), (1, "2024-01-06", "late"), (1, "2023-12-29", "early"), (1, "2024-01-02", None)]
    stories = spark.createDataFrame(events, "permco long, a string, headline string")
    stories = stories.select("permco", F.col("a").cast("date").alias("announcedate"), "headline")
    found = sorted((r.permco, r.end_date.isoformat(), r.headline) for r in news.news_for_next_week(bar, stories).collect())
    assert found == [
        (1, "2024-01-12", "No_Headlines"), (1, "2024-01-12", "first"), (1, "2024-01-12", "last"),
        (1, "2024-01-19", "late"), (2, "2024-01-12", "No_Headlines"),
    ]


def test_missing_headlines_match_each_other(spark):
    events = spark.createDataFrame([(1, None, "2005-02-01"), (2, None, "2016-02-01"), (3, "x", "2005-02-01")], "keydevid long, headline string, a string")
    events = events.select("keydevid", "headline", F.col("a").cast("date").alias("announcedate"))
    detail = spark.createDataFrame([(1, None, "s1"), (2, None, "s2"), (3, None, "s3")], "keydevid long, headline string, situation string")
    found = {r.keydevid: r.situation for r in news.add_situation(events, detail).collect()}
    assert found == {1: "s1", 2: "s2", 3: None}
    early = {r.keydevid: r.situation for r in news.add_situation(events, detail, ("2005-01-01", "2015-12-31")).collect()}
    assert early == {1: "s1", 2: None, 3: None}


def test_scores_without_positives_are_zero(spark):
    frame = spark.createDataFrame([("m", 1, 0), ("m", 0, 0)], "model string, true_direction int, predicted_direction int")
    row = scores.binary_metrics(frame, ["model"]).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)
    assert scores.with_matrix(scores.confusion_counts(frame, ["model"])).first().confusion_matrix == [[1, 0], [1, 0]]


def test_best_model_tie_goes_to_the_first_name(spark):
    frame = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "b", 0.9), (2, "a", 0.1)], "year int, model string, accuracy double")
    found = {r.year: r.best_model for r in scores.best_model(frame, "year").collect()}
    assert found == {1: "a", 2: "b"}
    assert scores.best_model_overall(frame, "year").first().best_model == "b"


def test_tied_scores_pick_by_name(spark):
    frame = spark.createDataFrame([("m", t, 0.5) for t in "DCBA"], "model string, ticker string, score double")
    legs = {}
    for row in portfolio.long_short_picks(frame, 2).orderBy("leg_rank").collect():
        legs.setdefault(row.leg, []).append(row.ticker)
    assert legs == {"long": ["D", "C"], "short": ["A", "B"]}


def test_few_tickers_fill_both_legs(spark):
    frame = spark.createDataFrame([("m", "A", 0.0), ("m", "B", 1.0), ("m", "C", 1.0)], "model string, ticker string, score double")
    weights = portfolio.portfolio_weights(portfolio.long_short_picks(frame, 10)).collect()
    assert len(weights) == 6 and all(w.ew == pytest.approx(1 / 3) for w in weights)
    assert sum(w.vw for w in weights if w.leg == "long") == pytest.approx(1.0)


def test_zero_scores_earn_nothing_and_every_week_is_there(spark):
    weights = portfolio.portfolio_weights(portfolio.long_short_picks(
        spark.createDataFrame([("m", "A", 0.0), ("m", "B", 0.0)], "model string, ticker string, score double"), 1))
    rows = [(GROSS, "2024-01-01", "A", 0.1), (GROSS, "2024-01-08", "Z", 0.3), (NET, "2024-01-01", "B", 0.2)]
    rets = spark.createDataFrame(rows, "scenario string, week string, ticker string, ret double")
    found = portfolio.portfolio_returns(weights, rets, [GROSS, NET])
    table = {(r.scenario, r.week, r.type): r.ret for r in found.collect()}
    assert {r.model for r in found.collect()} == {"m"}
    assert len(table) == 2 * 2 * 6
    assert all(v == 0.0 for k, v in table.items() if k[2].startswith("VW") or k[1] == "2024-01-08")
    assert table[(GROSS, "2024-01-01", "EW S")] == pytest.approx(0.1)
    assert table[(GROSS, "2024-01-01", "EW LS")] == pytest.approx(-0.1)


def test_sharpe_of_a_constant_is_null(spark):
    frame = spark.createDataFrame([("c", 0.5), ("c", 0.5), ("v", 1.0), ("v", 3.0)], "k string, r double")
    found = {r.k: r.s for r in frame.groupBy("k").agg(portfolio.sharpe(F.col("r")).alias("s")).collect()}
    assert found["c"] is None and found["v"] == pytest.approx(2.0 / math.sqrt(2.0))


def test_unknown_class_pays_the_small_cost(spark):
    rows = [("A", day("2024-01-01"), 1.0, 1, None), ("A", day("2024-01-08"), 1.1, 3, 0.1), ("B", day("2024-01-08"), 1.0, 1, 0.0)]
    frame = spark.createDataFrame(rows, "ticker string, start_date date, price double, n_rows long, ret double")
    classes = spark.createDataFrame([(day("2024-01-08"), "A", "Large"), (day("2024-01-08"), "A", "Small")], "date date, ticker string, size_class string")
    net = {r.ticker: r for r in returns.net_returns(frame, classes).collect()}
    assert net["A"].net_ret == pytest.approx(0.1 - 0.001121) and net["B"].net_ret == pytest.approx(-0.002127)
    per_row = {r.ticker: r for r in returns.net_returns(frame, classes, cost_per_row=True).collect()}
    assert per_row["A"].net_ret == pytest.approx((1.1 - 0.001121) * (1 - 0.001121) ** 2 - 1)


def test_zero_price_gives_no_return(spark):
    rows = [(1, "A", day("2024-01-01"), 0.0), (1, "A", day("2024-01-08"), 2.0)]
    found = returns.period_return(spark.createDataFrame(rows, "permco long, ticker string, start_date date, adj_prc double"))
    assert [r.ret for r in found.orderBy("start_date").collect()] == [None, None]


def test_histogram_edges_and_empty_bins(spark):
    frame = spark.createDataFrame([(0.0,), (10.0,), (None,)], "v double")
    assert {r.bin: r.n for r in profiling.histogram(frame, "v", 5).collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r.bin: r.n for r in profiling.histogram(flat, "v", 2).collect()} == {1: 2, 2: 0}


def test_labels_renames_and_validation(spark):
    frame = spark.createDataFrame([("Up",), ("Down",), ("?",)], "direction string")
    assert [r[0] for r in frame.select(cleaning.label_code(F.col("direction"))).collect()] == [1, 0, None]
    assert cleaning.rename(frame, cleaning.PANEL_NAMES).columns == ["Direction"]
    assert cleaning.require_complete(frame) is frame
    with pytest.raises(cleaning.MissingValues, match="x: 1"):
        cleaning.require_complete(spark.createDataFrame([(1, None)], "k int, x int"))


def test_coercions(spark):
    frame = spark.createDataFrame([("1.5",), ("C",), (None,)], "t string")
    assert [r[0] for r in frame.select(numbers.coerce_double(F.col("t"))).collect()] == [1.5, None, None]
    clock = spark.createDataFrame([("2024-01-01 23:30:00-05:00",)], "t string").select(numbers.wall_clock(F.col("t"))).first()[0]
    assert clock == dt.datetime(2024, 1, 1, 23, 30)
    assert frame.select(numbers.nan_to_null(F.lit(float("nan")))).first()[0] is None
    with pytest.raises(Exception):
        frame.where("t = 'C'").select(numbers.strict_day(F.col("t"))).collect()


def test_tokens_and_sequences(spark):
    frame = spark.createDataFrame([(1, "A b Cd_9, éÉ x! " + "zz " * 5), (2, "")], "doc long, body string")
    assert frame.select(text.tokens(F.col("body"))).first()[0] == ["cd_9", "éé"] + ["zz"] * 5
    rows = tokens.token_sequences(frame, "body", "doc", max_tokens=3, batch=2).orderBy("doc", "seq_no").collect()
    assert [(r.doc, r.seq_no, r.batch_no, r.n_tokens, r.width) for r in rows] == [
        (1, 0, 0, 3, 3), (1, 1, 0, 3, 3), (1, 2, 1, 1, 1), (2, 0, 1, 0, 1)]
    assert rows[3].tokens == [""] and rows[3].mask == [0]
    first = tokens.token_sequences(frame, "body", "doc", max_tokens=3, batch=2, first_only=True).orderBy("doc").collect()
    assert [(r.doc, r.n_tokens, r.mask) for r in first] == [(1, 3, [1, 1, 1]), (2, 0, [0, 0, 0])]


def test_bigrams_and_hashed_vector(spark):
    frame = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in frame.select(text.bigrams(F.col("w"))).collect()] == [["a b", "b c"], [], []]
    vectors_ = [r[0] for r in frame.select(text.hashed_vector(F.col("w"), 8)).collect()]
    assert [round(sum(v), 9) for v in vectors_] == [1.0, 1.0, 0.0] and all(len(v) == 8 for v in vectors_)


def test_flatten(spark):
    frame = spark.sql("select 1 as a, named_struct('b', 2, 'c', named_struct('d', 3)) as s")
    assert nested.flatten(frame).columns == ["a", "s_b", "s_c_d"]


def test_joined_text_comes_in_parts(spark):
    frame = spark.createDataFrame([("A", i, f"h{i}") for i in range(5)] + [("B", 0, "x")], "ticker string, n int, headline string")
    found = {(r.ticker, r.part): r.text for r in tokens.joined_text(frame, "headline", "ticker", ["n"], 2).collect()}
    assert found == {("A", 0): "h0 h1", ("A", 1): "h2 h3", ("A", 2): "h4", ("B", 0): "x"}


def test_metric_grid_keeps_models_that_never_ran(spark):
    frame = spark.createDataFrame([(1, 2020, "a", 1.0, 1.0, 1.0, 1.0)], "permco long, year int, model string, accuracy double, precision double, recall double, f1 double")
    found = {r.model: r.accuracy for r in scores.metric_grid(frame, ["permco", "year"], ["a", "z"]).collect()}
    assert found == {"a": 1.0, "z": None}


def test_cumulative_return(spark):
    frame = spark.createDataFrame([("s", 1, 0.1), ("s", 2, -0.5), ("s", 3, 1.0)], "k string, week int, ret double")
    found = [r.cum_ret for r in portfolio.cumulative_returns(frame, ["k"]).orderBy("week").collect()]
    assert found == pytest.approx([0.1, -0.45, 0.1])


def test_days_in_several_forms(spark):
    texts = ["2016-01-04", "20160104", "2016/01/04", "01/04/2016", "2016", "2016-1-4x", "13/40/2016", "not a day", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [str(r.d) for r in frame.select("i", numbers.coerce_day(F.col("t")).alias("d")).orderBy("i").collect()]
    assert found == ["2016-01-04"] * 4 + ["None"] * 5


def test_days_with_times_and_short_parts(spark):
    days = ["2016-01-04 00:00:00", "2016-01-04T09:30:00", "2016-01-04T23:30:00.25-05:00", "2016-1-4", "1/4/2016", "2016/1/4", "1/4/2016 9:30", "20160104 09:30"]
    texts = [*days, "2016", "2016-1-4T", "2016-01-04 25:00:00", "2016-2-30", "2016-01-04 noon"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [str(r.d) for r in frame.select("i", numbers.coerce_day(F.col("t")).alias("d")).orderBy("i").collect()]
    assert found == ["2016-01-04"] * len(days) + ["None"] * 5


def test_nan_is_no_price_and_no_return(spark):
    frame = spark.createDataFrame([(1.0, 0.1), (float("nan"), 0.1), (2.0, float("nan")), (3.0, None), (-1.0, 0.2)], "prc double, ret double")
    assert [tuple(r) for r in bars.tradable(frame).collect()] == [(1.0, 0.1)]


def test_models_outside_the_list(spark):
    weights = spark.createDataFrame([("a", "X", "long", 1.0, 1.0), ("b", "X", "short", 1.0, 1.0)], "model string, ticker string, leg string, ew double, vw double")
    rets = spark.createDataFrame([("X", "gross", "w1", 0.1)], "ticker string, scenario string, week string, ret double")
    series = portfolio.portfolio_returns(weights, rets, ["gross"])
    assert {r.model for r in series.collect()} == {"a", "b"}
    with pytest.raises(Exception, match="model without a column"):
        portfolio.risk_table_wide(portfolio.risk_table(series), ["a"]).collect()


def test_nan_counts_as_missing(spark):
    frame = spark.createDataFrame([(1, float("nan")), (2, None), (None, 3.0)], "k long, x double")
    assert {r.column_name: r.n_null for r in cleaning.null_counts(frame).collect()} == {"k": 1, "x": 2}
    with pytest.raises(cleaning.MissingValues):
        cleaning.require_complete(frame.where("k = 1"))


def test_not_a_number_is_a_missing_price(spark):
    nan = float("nan")
    rows = [(1, "A", "2010-01-04", 2.0, 10.0), (1, "A", "2010-01-05", nan, 10.0), (2, "B", "2010-01-04", nan, 5.0), (3, "C", "2010-01-04", 1.0, nan), (3, "C", "2010-01-05", 9.0, 1.0)]
    frame = spark.createDataFrame(rows, "permno long, comnam string, date string, prc double, shrout double").withColumn("date", F.col("date").cast("date"))
    assert {r.permno: r.avg_cap for r in universe.average_market_cap(frame).collect()} == {1: 20.0, 2: None, 3: 9.0}
    assert [r.permno for r in universe.top_universe(frame, ("2005-01-01", "2015-12-31"), 2).collect()] == [1, 3]
    assert {r.date.isoformat(): r.avg_cap for r in universe.market_cap_by_day(frame).collect()} == {"2010-01-04": 20.0, "2010-01-05": 9.0}
    bins = profiling.histogram(frame, "prc", 2).orderBy("bin").collect()
    assert [(r.bin, r.bin_low, r.bin_high, r.n) for r in bins] == [(1, 1.0, 5.0, 2), (2, 5.0, 9.0, 1)]
    stats = {r.column_name: r for r in profiling.summary_stats(frame, ["prc", "shrout"]).collect()}
    assert (stats["prc"].n, stats["prc"]["max"], stats["prc"].q50, stats["shrout"].n) == (3, 9.0, 2.0, 4)


def test_written_frames_are_checked_in_the_same_run(spark):
    frame = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5)], "k long, t string, v double")
    assert sorted(map(tuple, cleaning.write_complete(frame).collect())) == [(1, "a", 1.5), (2, "b", 2.5)]
    assert cleaning.write_complete(frame.limit(0)).count() == 0
    for bad, said in (((3, None, 1.0), "t: 1"), ((3, "c", float("nan")), "v: 1"), ((None, "c", None), "k: 1, v: 1")):
        with pytest.raises(cleaning.MissingValues, match=said):
            cleaning.write_complete(frame.unionByName(spark.createDataFrame([bad], frame.schema)))


def test_document_vectors(spark):
    terms = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3), (2, "c", 1), (3, "b", 1), (3, "a", 1), (4, "z", 1)], "k long, token string, n long")
    words = tokens.vocabulary(terms, 2)
    assert sorted(map(tuple, words.collect())) == [("a", 1, 2), ("b", 0, 3)]
    found = {r.k: (r.indices, r.counts) for r in tokens.document_vectors(terms, words, "k").collect()}
    assert found == {1: ([0, 1], [1, 2]), 2: ([0], [3]), 3: ([0, 1], [1, 1])}


def test_sketches_merge(spark):
    frame = spark.range(100_000).select((F.col("id") % 30).alias("day"), F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("id") * 1.0).alias("v"))
    sketches = profiling.quantile_sketches(frame, ["v"], ["day"])
    assert sketches.count() == 27 and sketches.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    whole = profiling.sketch_quantiles(sketches, [], {"a": 0.1, "m": 0.5, "z": 0.99}).first()
    assert (whole.n, whole["min"], whole["max"]) == (90_000, 1.0, 99_999.0)
    for name, p in (("a", 0.1), ("m", 0.5), ("z", 0.99)):
        assert abs(whole[name] / 100_000 - p) <= profiling.SKETCH_RANK_ERROR
