"""Registered queries: name -> (session, folder of the parquet tables) -> DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom import schemas
from tickerloom.functions import dates, nested, numbers, text
from tickerloom.operators import (
    bars, cleaning, cooccurrence, logistic, news, ordered, pooled, portfolio, profiling, returns, scores, tokens, trainer, universe, vectors,
)
from tickerloom.params import GROSS, MOVING_AVERAGE_ROWS, SIC_BAND, UNIVERSE_SIZE
from tickerloom.plans import chain
from tickerloom.plans.panel import compact_vectors, period_bars, period_panel, written_label_rows
from tickerloom.plans.report import portfolio_series, weekly_returns
from tickerloom.session import pin, scratch_path
from tickerloom.sources import delimited, layouts, studyviews as views, tables
from tickerloom.sources.studyviews import PERIODS, RULE_MODELS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
DAILY = ["permno", "permco", "ticker", "comnam", "siccd", "exchcd", "date", "prc", "shrout", "cfacpr", "ret", "rec_id", "rec_line"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles on a decimal grid, so that results of two engines compare equal.

    The small shift keeps exact decimal ties, such as a half cent, off the border between two grid points.
    """
    scale = 10.0**digits
    names = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.floor(F.col(name) * scale + 0.5137) / scale for name in names})


# ---- tables, files, folders ------------------------------------------------------------------------


def _sql_panel(spark: SparkSession, folder: str, text_: str) -> DataFrame:
    tables.register_views({
        "daily_prices": views.panel_daily(spark, folder).select("permno", "permco", "date", "prc", "shrout", "cfacpr", "ret"),
        "stock_names": views.stock_names(spark, folder),
    })
    first, last = PERIODS.estimation
    args = {"sic_low": SIC_BAND[0], "sic_high": SIC_BAND[1], "first_day": first, "last_day": last}
    return rounded(tables.run_sql(spark, text_, args))


@query
def sql_daily_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _sql_panel(spark, folder, universe.DAILY_PANEL_SQL)


@query
def sql_daily_panel_asof(spark: SparkSession, folder: str) -> DataFrame:
    return _sql_panel(spark, folder, universe.DAILY_PANEL_ASOF_SQL)


@query
def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    tables.register_views({name: tables.read_table(spark, folder, name) for name in TABLES})
    return tables.with_row_counts(spark, tables.list_tables(spark), TABLES)


@query
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    daily = views.panel_daily(spark, folder).select(*DAILY)
    path = scratch_path(spark, "daily-csv")
    delimited.write_csv(daily, path)
    return rounded(delimited.read_csv(spark, path, daily.schema))


def _size_input(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "size-csv")
    views.dirty_size_lines(spark, folder).write.text(path)
    return delimited.read_csv_skipping_wide_rows(spark, path, schemas.SIZE_INPUT, header=False)


@query
def csv_skip_bad_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _size_input(spark, folder).select(
        F.col("date").alias("day_text"), F.col("TICKER").alias("ticker"), F.col("EXCHCD").alias("exchcd"),
        F.col("PRC").alias("prc_text"), F.col("SHROUT").alias("shrout_text"),
    )


@query
def coerce_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return _size_input(spark, folder).select(
        F.col("TICKER").alias("ticker"), F.col("PRC").alias("prc_text"),
        numbers.coerce_double(F.col("PRC")).alias("prc"), numbers.coerce_double(F.col("SHROUT")).alias("shrout"),
    )


@query
def coerce_date(spark: SparkSession, folder: str) -> DataFrame:
    stamped = F.concat("date", F.lit("T09:30:00+05:00"))
    return _size_input(spark, folder).select(
        F.col("TICKER").alias("ticker"), F.col("date").alias("day_text"),
        numbers.coerce_day(F.col("date")).alias("day"),
        F.date_format(numbers.wall_clock(stamped), "yyyy-MM-dd HH:mm:ss").alias("clock"),
    )


@query
def partitioned_write_read(spark: SparkSession, folder: str) -> DataFrame:
    rows = period_bars(views.panel_daily(spark, folder), PERIODS).withColumn(
        "split", F.when(F.col("period") == "estimation", "train").otherwise("test")
    ).drop("period")
    path = scratch_path(spark, "by-company")
    layouts.write_by_keys(rows, path, ["permco", "split"])
    return rounded(layouts.read_by_keys(spark, path, rows.schema, ["permco", "split"]))


@query
def collect_predictions(spark: SparkSession, folder: str) -> DataFrame:
    path, schema = _result_tree(spark, folder)
    return layouts.collect_results(spark, path, schema, layouts.HIVE_LAYOUT, "parquet", prune=False)


def _result_tree(spark: SparkSession, folder: str) -> tuple[str, T.StructType]:
    path = scratch_path(spark, "results")
    layouts.write_by_keys(views.rule_predictions(spark, folder), path, ["permco", "model"])
    names = {"ticker", "end_date", "true_direction", "predicted_direction"}
    return path, T.StructType([f for f in schemas.PREDICTIONS.fields if f.name in names])


@query
def predictions_of_company(spark: SparkSession, folder: str) -> DataFrame:
    """The results of one company: the other folders are not listed."""
    path, schema = _result_tree(spark, folder)
    return layouts.collect_results(spark, path, schema, layouts.HIVE_LAYOUT, "parquet", company=7)


@query
def predictions_of_model(spark: SparkSession, folder: str) -> DataFrame:
    """The results of one model by a manifest of the files, as for trees whose folders are no partitions."""
    path, schema = _result_tree(spark, folder)
    manifest = layouts.result_manifest(spark, path, layouts.HIVE_LAYOUT)
    return layouts.read_manifest(manifest.where("model = 'trend'"), schema, "parquet")


# ---- cleaning and profiles -------------------------------------------------------------------------


@query
def market_cap(spark: SparkSession, folder: str) -> DataFrame:
    daily = views.panel_daily(spark, folder).withColumn("market_cap", bars.market_cap())
    return rounded(daily.select("permno", "date", "rec_id", "rec_line", "market_cap"))


@query
def clean_daily(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.drop_incomplete(views.panel_daily(spark, folder)).dropDuplicates())


@query
def null_report(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.null_counts(views.panel_daily(spark, folder))


@query
def schema_profile(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.schema_profile(views.panel_daily(spark, folder))


@query
def summary_stats(spark: SparkSession, folder: str) -> DataFrame:
    daily = cleaning.drop_incomplete(views.panel_daily(spark, folder)).withColumn("market_cap", bars.market_cap())
    return rounded(profiling.summary_stats(daily, ["prc", "shrout", "cfacpr", "ret", "market_cap"]), 3)


@query
def sketch_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, minimum and maximum per column from sketches by day, merged; how far their quartiles are off is within the stated error."""
    daily = views.panel_daily(spark, folder).withColumn("market_cap", bars.market_cap())
    names = ["prc", "ret", "market_cap"]
    sketches = pin(profiling.quantile_sketches(daily, names, ["date"]), "sketches")
    wanted = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    merged = profiling.sketch_quantiles(sketches, [], wanted)
    long = daily.select(*names).unpivot([], names, "column_name", "value").where("value is not null")
    below = [F.avg((F.col("value") < F.col(name)).cast("double")).alias(f"below_{name}") for name in wanted]
    upto = [F.avg((F.col("value") <= F.col(name)).cast("double")).alias(f"upto_{name}") for name in wanted]
    there = long.join(merged, "column_name").groupBy("column_name").agg(*below, *upto)
    off = F.lit(profiling.SKETCH_RANK_ERROR)
    close = [((F.col(f"below_{name}") - off <= p) & (F.col(f"upto_{name}") + off >= p)).alias(f"{name}_close") for name, p in wanted.items()]
    return rounded(merged.join(there, "column_name").select("column_name", "n", "min", "max", *close), 3)


@query
def market_cap_histogram(spark: SparkSession, folder: str) -> DataFrame:
    daily = views.panel_daily(spark, folder).select(bars.market_cap().alias("market_cap"))
    return rounded(profiling.histogram(daily, "market_cap"), 4)


@query
def event_type_top(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.top_categories(views.news_linked(spark, folder), "eventtype")


@query
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    daily = views.panel_daily(spark, folder).select("date", "comnam", "permno", "rec_id", "rec_line", "prc")
    return rounded(universe.first_rows(daily, ["date", "comnam", "permno", "rec_id", "rec_line", "prc"], 25))


# ---- universe, links, weeks ------------------------------------------------------------------------


def _universe(spark: SparkSession, folder: str) -> DataFrame:
    return universe.top_universe(universe.in_industry(views.panel_daily(spark, folder)), PERIODS.estimation)


@query
def avg_market_cap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(universe.average_market_cap(views.panel_daily(spark, folder)), 2)


@query
def market_cap_by_date(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(universe.market_cap_by_day(views.panel_daily(spark, folder)), 2)


@query
def universe_topn(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_universe(spark, folder), 2)


@query
def universe_filter(spark: SparkSession, folder: str) -> DataFrame:
    daily = views.panel_daily(spark, folder)
    later = daily.where(dates.in_range(F.col("date"), PERIODS.out_of_sample))
    return rounded(universe.keep_listed(later, _universe(spark, folder), "permno").select(
        "permno", "date", "prc", "shrout", "ret", "rec_id", "rec_line"
    ))


@query
def event_link_join(spark: SparkSession, folder: str) -> DataFrame:
    return news.link_events(views.news_events(spark, folder), views.link_table(spark, folder))


@query
def event_detail_join(spark: SparkSession, folder: str) -> DataFrame:
    return news.add_situation(views.news_events(spark, folder), views.news_detail(spark, folder))


@query
def event_detail_join_estimation(spark: SparkSession, folder: str) -> DataFrame:
    return news.add_situation(views.news_events(spark, folder), views.news_detail(spark, folder), PERIODS.estimation)


@query
def week_keys(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("day")
    orders = tables.read_table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return orders.withColumn("week_end", dates.week_end(day)).select(
        "o_orderkey", "day", "week_end", dates.week_start(F.col("week_end")).alias("week_start"),
        dates.following_friday(F.col("week_end")).alias("next_friday"),
        dates.calendar_week(day).alias("calendar_week"), dates.year_of(day).alias("year"),
        dates.quarter_index(day).alias("quarter_index"),
    )


BAR = ["permco", "ticker", "start_date", "end_date", "weekly_ret", "adj_prc"]


@query
def weekly_bars(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(bars.weekly_bars(views.panel_daily(spark, folder)).select(*BAR))


@query
def direction(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(views.weekly(spark, folder).select(*BAR, "direction"))


@query
def news_lag_join(spark: SparkSession, folder: str) -> DataFrame:
    panel = news.news_for_next_week(views.weekly(spark, folder), views.news_linked(spark, folder))
    return rounded(panel.select(*BAR, "headline", "direction"))


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    return period_panel(views.panel_daily(spark, folder), views.news_linked(spark, folder), PERIODS)


@query
def clean_panel(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.clean_panel(_panel(spark, folder), ["period"]))


@query
def validated_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The clean panel of the estimation period, checked for missing values while it is written."""
    panel = cleaning.clean_panel(_panel(spark, folder).where("period = 'estimation'"))
    return rounded(cleaning.write_complete(panel))


def _moving_average(spark: SparkSession, folder: str, within: list[str], order: list[str]) -> DataFrame:
    panel = news.news_for_next_week(views.weekly(spark, folder), views.news_linked(spark, folder))
    # Range partitioning reads its input twice, so the panel is written once.
    rows = pin(panel.select("permco", "ticker", "end_date", "headline", "adj_prc").dropDuplicates(), "panel")
    return rounded(ordered.rolling_mean(rows, "adj_prc", within, order, MOVING_AVERAGE_ROWS, "ma5"))


@query
def ma5_by_ticker(spark: SparkSession, folder: str) -> DataFrame:
    return _moving_average(spark, folder, ["permco", "ticker"], ["end_date", "headline"])


@query
def ma5_global(spark: SparkSession, folder: str) -> DataFrame:
    return _moving_average(spark, folder, [], ["permco", "ticker", "end_date", "headline"])


# ---- text ------------------------------------------------------------------------------------------


@query
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(tables.read_table(spark, folder, "documents"), "text", "lang")


@query
def top_tokens(spark: SparkSession, folder: str) -> DataFrame:
    panel = news.news_for_next_week(views.weekly(spark, folder), views.news_linked(spark, folder))
    return tokens.top_tokens(tokens.token_counts(tokens.with_headline(panel), "headline", "ticker"), "ticker")


@query
def doc_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.document_terms(tables.read_table(spark, folder, "documents"), "text", "doc_id")


@query
def doc_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse count vectors of the documents over the ranked vocabulary."""
    terms = pin(tokens.document_terms(tables.read_table(spark, folder, "documents"), "text", "doc_id"), "terms")
    found = tokens.document_vectors(terms, tokens.vocabulary(terms, 2), "doc_id")
    joined = [F.array_join(F.transform(name, lambda x: x.cast("string")), " ").alias(name) for name in ("indices", "counts")]
    return found.select("doc_id", *joined)


@query
def headline_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.news_linked(spark, folder).withColumn("ticker", F.concat(F.lit("T"), F.col("permco").cast("string")))
    return tokens.joined_text(rows, "headline", "ticker", ["headline", "keydevid"], 100)


@query
def token_sequences(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.token_sequences(tables.read_table(spark, folder, "documents"), "text", "doc_id")
    return rows.select(
        "doc_id", "seq_no", "batch_no", "n_tokens", "width", F.array_join("tokens", " ").alias("tokens"),
        F.array_join(F.transform("mask", lambda m: m.cast("string")), "").alias("mask"),
    )


WIDTH = 64


@query
def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(vectors.hashed_long(tables.read_table(spark, folder, "documents"), "text", "doc_id", WIDTH))


def hashing_encoder() -> vectors.Encoder:
    """An encoder as a user would supply one: the mean hashed vector, in Python."""
    token = regex.compile(text.TOKEN_PATTERN)

    def encode(batch: list[str]) -> np.ndarray:
        out = np.zeros((len(batch), WIDTH))
        for row, words in enumerate(token.findall(body.lower()) for body in batch):
            for word in words:
                out[row, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % WIDTH] += 1.0 / len(words)
        return out

    return encode


@query
def embed_with_udf(spark: SparkSession, folder: str) -> DataFrame:
    documents = tables.read_table(spark, folder, "documents").select("doc_id", "text")
    encoded = vectors.encode_with(documents, "text", hashing_encoder, 16)
    cells = encoded.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where("value > 0")
    return rounded(cells)


@query
def word2vec_embedding(spark: SparkSession, folder: str) -> DataFrame:
    documents = tables.read_table(spark, folder, "documents").select("doc_id", "text")
    return vectors.word_vectors(documents, "text").select("doc_id", "embedding")


def rule_encoder() -> vectors.SequenceEncoder:
    """A sequence encoder that SQL can express: length, place and a hash of every token."""

    def encode(batch: list[list[str]], mask: np.ndarray) -> np.ndarray:
        found = [[(len(word), place, int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 100) for place, word in enumerate(row)] for row in batch]
        return np.array(found, float).reshape(*mask.shape, 3)

    return encode


@query
def embed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Padded batches of token sequences through an encoder, pooled under the mask over all parts of a document."""
    rows = tokens.token_sequences(tables.read_table(spark, folder, "documents"), "text", "doc_id")
    found = vectors.encode_sequences(rows, "doc_id", rule_encoder)
    return rounded(found.select("doc_id", "n_tokens", *[F.get("embedding", F.lit(i)).alias(name) for i, name in enumerate(("length", "place", "hash"))]))


@query
def word_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of words that stand within two words of each other, four times or more."""
    documents = tables.read_table(spark, folder, "documents")
    return cooccurrence.pair_counts(documents, "text").where("n >= 4")


@query
def word_information(spark: SparkSession, folder: str) -> DataFrame:
    """Positive mutual information of the pairs of words that occur thirty times or more."""
    documents = tables.read_table(spark, folder, "documents")
    words = pin(cooccurrence.word_counts(documents, "text", 30).select("word"), "words")
    return rounded(cooccurrence.information(cooccurrence.pair_counts(documents, "text"), words))


@query
def cooccurrence_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the mean of word vectors from the co-occurrence table."""
    documents = tables.read_table(spark, folder, "documents").select("doc_id", "text")
    found = pin(cooccurrence.word_vectors(documents, "text", width=16, least=30), "word-vectors")
    return cooccurrence.mean_vectors(documents, "text", "doc_id", found)


@query
def parse_vectors(spark: SparkSession, folder: str) -> DataFrame:
    stored = tables.read_table(spark, folder, "embeddings").select("vec_id", F.to_json("embedding").alias("as_text"))
    parsed = stored.select("vec_id", F.posexplode(text.parse_vector(F.col("as_text"))).alias("place", "value"))
    return parsed.withColumn("value", F.col("value").cast("float").cast("double"))


@query
def argmax_label(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_table(spark, folder, "embeddings").select("vec_id", numbers.argmax(F.col("embedding")).alias("best"))


# ---- scores and rankings ---------------------------------------------------------------------------


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return views.rule_predictions(spark, folder).withColumn("year", F.year("end_date"))


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return scores.binary_metrics(_predictions(spark, folder), ["permco", "year", "model"])


@query
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_metrics(spark, folder))


@query
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    counts = scores.with_matrix(scores.confusion_counts(_predictions(spark, folder), ["permco", "model"]))
    return counts.select("permco", "model", F.to_json("confusion_matrix").alias("matrix"))


@query
def error_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scores.error_by_model(_predictions(spark, folder)))


@query
def metrics_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scores.mean_metrics(_metrics(spark, folder)))


@query
def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scores.metrics_long(_metrics(spark, folder), ["permco", "year", "model"]))


@query
def metric_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The rule models and one that never ran, per company and year."""
    return rounded(scores.metric_grid(_metrics(spark, folder), ["permco", "year"], [*RULE_MODELS, "absent"]))


@query
def best_model_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scores.best_model(_metrics(spark, folder), "year"))


@query
def best_model_by_company(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scores.best_model(_metrics(spark, folder), "permco"))


@query
def best_model_overall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scores.best_model_overall(_metrics(spark, folder), "year"))


@query
def best_model_share(spark: SparkSession, folder: str) -> DataFrame:
    return scores.best_model_share(scores.best_model(_metrics(spark, folder), "permco"))


@query
def metrics_per_year(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scores.metrics_per_year(_predictions(spark, folder)))


@query
def metrics_per_year_true(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scores.metrics_per_year(_predictions(spark, folder), true_per_year=True))


@query
def flatten_structs(spark: SparkSession, folder: str) -> DataFrame:
    nested_rows = _metrics(spark, folder).select(
        "permco", "year", "model",
        F.struct("accuracy", "f1", F.struct("tn", "fp", "fn", "tp").alias("counts")).alias("metrics"),
    )
    return rounded(nested.flatten(nested_rows))


# ---- returns and portfolios ------------------------------------------------------------------------


def _later_daily(spark: SparkSession, folder: str) -> DataFrame:
    daily = views.panel_daily(spark, folder)
    return daily.where(dates.in_range(F.col("date"), PERIODS.out_of_sample))


def _later_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars.weekly_bars(_later_daily(spark, folder))


@query
def size_class(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(returns.size_class(views.panel_daily(spark, folder)).select(
        "date", "ticker", "rec_id", "rec_line", "cap", "median_cap", "size_class"
    ), 4)


@query
def period_return(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(returns.period_return(_later_bars(spark, folder)).select("ticker", "start_date", "price", "ret"))


@query
def cost_adjusted_returns(spark: SparkSession, folder: str) -> DataFrame:
    classes = returns.size_class(_later_daily(spark, folder))
    return rounded(returns.net_returns(returns.period_return(_later_bars(spark, folder)), classes).select(
        "ticker", "start_date", "ret", "size_class", "cost", "net_ret"
    ))


def _weekly(spark: SparkSession, folder: str) -> DataFrame:
    return weekly_returns(_later_bars(spark, folder), _later_daily(spark, folder))


def _pinned_weekly(spark: SparkSession, folder: str) -> DataFrame:
    return pin(_weekly(spark, folder), "weekly")


@query
def weekly_compound(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_weekly(spark, folder))


@query
def weekly_compound_row_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Costs charged per headline row of the panel."""
    panel = news.news_for_next_week(bars.weekly_bars(_later_daily(spark, folder)), views.news_linked(spark, folder))
    rows = panel.select("permco", "ticker", "start_date", "adj_prc", "headline").dropDuplicates()
    return rounded(weekly_returns(rows, _later_daily(spark, folder), cost_per_row=True))


@query
def market_return(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(returns.market_return(returns.by_scenario(_weekly(spark, folder)), ["scenario", "week"]))


@query
def market_cumulative(spark: SparkSession, folder: str) -> DataFrame:
    market = returns.market_return(returns.by_scenario(_weekly(spark, folder)), ["scenario", "week"])
    digits = F.format_string("%.5e", "cum_ret").cast("double")
    return portfolio.cumulative_returns(market, ["scenario"]).select("scenario", "week", digits.alias("cum_ret"))


RANK_LABELS = [f"top_{rank:02d}" for rank in range(1, UNIVERSE_SIZE + 1)]


def _returns_matrix(spark: SparkSession, folder: str, value: str) -> DataFrame:
    """Week x company matrix of the largest companies of the estimation period, columns in size order."""
    largest = universe.top_universe(views.panel_daily(spark, folder), PERIODS.estimation)
    # A list of the universe size: 25 rows, small enough to be numbered in one place and broadcast.
    order = F.sort_array(F.collect_list(F.struct((-F.col("avg_cap")).alias("size"), "permno")))
    labels = largest.agg(order.alias("o")).select(F.posexplode("o").alias("place", "c")).select(
        F.concat(F.lit("T"), F.col("c.permno").cast("string")).alias("ticker"),
        F.format_string("top_%02d", F.col("place") + 1).alias("label"),
    )
    return returns.returns_matrix(_weekly(spark, folder).join(F.broadcast(labels), "ticker"), RANK_LABELS, "label", value)


@query
def returns_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_returns_matrix(spark, folder, "ret"))


@query
def returns_matrix_net(spark: SparkSession, folder: str) -> DataFrame:
    """The matrix after costs, written as sorted files and read back."""
    matrix = _returns_matrix(spark, folder, "net_ret")
    path = scratch_path(spark, "net-matrix")
    delimited.write_csv(matrix, path, ["week"])
    return rounded(delimited.read_csv(spark, path, matrix.schema))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return portfolio.ticker_scores(views.rule_predictions(spark, folder), _later_bars(spark, folder))


@query
def ticker_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_scores(spark, folder))


@query
def long_short_picks(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(portfolio.long_short_picks(_scores(spark, folder)))


@query
def portfolio_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(portfolio.portfolio_weights(portfolio.long_short_picks(_scores(spark, folder))))


def _series(spark: SparkSession, folder: str) -> DataFrame:
    return portfolio_series(views.rule_predictions(spark, folder), _pinned_weekly(spark, folder))


@query
def portfolio_returns(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_series(spark, folder))


@query
def cumulative_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Compounded over many weeks the values span many orders of magnitude, so they keep six digits each."""
    series = portfolio.cumulative_returns(_series(spark, folder), ["model", "scenario", "type"])
    digits = F.format_string("%.5e", "cum_ret").cast("double")
    return series.select("model", "scenario", "week", "type", digits.alias("cum_ret"))


@query
def risk_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(portfolio.risk_table(_series(spark, folder)))


@query
def risk_table_wide(spark: SparkSession, folder: str) -> DataFrame:
    return portfolio.risk_table_wide(portfolio.risk_table(_series(spark, folder)), RULE_MODELS)


@query
def sharpe_by_model(spark: SparkSession, folder: str) -> DataFrame:
    weekly = _pinned_weekly(spark, folder)
    series = portfolio_series(views.rule_predictions(spark, folder), weekly)
    gross = series.where(F.col("scenario") == GROSS)
    return rounded(portfolio.sharpe_by_model(gross, returns.market_return(weekly)))


# ---- models ----------------------------------------------------------------------------------------


def _label_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The headline rows of both periods, written without their vectors, which are many times as large."""
    return written_label_rows(views.panel_daily(spark, folder), views.news_records(spark, folder), PERIODS)


@query
def headline_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Non-zero entries of each encoder variant for every distinct headline."""
    headlines = views.news_linked(spark, folder).select("headline").distinct()
    cells = vectors.stack_variants(vectors.add_variants(headlines, "headline"))
    rows = cells.select("headline", "model", F.posexplode("features").alias("bucket", "value")).where("value > 0")
    return rounded(rows)


@query
def walk_forward_folds(spark: SparkSession, folder: str) -> DataFrame:
    rows = cleaning.clean_panel(_panel(spark, folder), ["period"]).select(
        F.col("Permco").alias("permco"), dates.quarter_index(F.col("Start_Date")).alias("unit"),
        F.col("Direction").alias("label"),
    )
    folds = logistic.walk_forward_folds(rows, ["permco"])
    return folds.withColumn("train_units", F.array_join(F.transform("train_units", lambda u: u.cast("string")), " "))


@query
def walk_forward_folds_years(spark: SparkSession, folder: str) -> DataFrame:
    """Ten training years and one test year of the stored vectors, whose ids are dealt over 19 years and two companies."""
    rows = tables.read_table(spark, folder, "embeddings").select(
        (F.col("vec_id") % 2).alias("permco"), (2005 + F.col("vec_id") % 19).alias("unit"), (F.col("label") >= 5).cast("int").alias("label"),
    )
    folds = logistic.walk_forward_folds(rows, ["permco"])
    return folds.withColumn("train_units", F.array_join(F.transform("train_units", lambda u: u.cast("string")), " "))


@query
def trainable_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = period_bars(views.panel_daily(spark, folder), PERIODS)
    return scores.trainable_groups(rows.where("period = 'estimation'"), rows.where("period = 'out_of_sample'"))


def _stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Both halves of the stored vectors as two models, in two companies."""
    both = F.array(
        F.struct(F.lit("first32").alias("model"), F.slice("embedding", 1, 32).alias("x")),
        F.struct(F.lit("last32").alias("model"), F.slice("embedding", 33, 32).alias("x")),
    )
    rows = tables.read_table(spark, folder, "embeddings").withColumn("v", F.explode(both)).select(
        (F.col("vec_id") % 2).alias("permco"), "v.model", (F.col("label") >= 5).cast("int").alias("label"),
        F.col("v.x").cast("array<double>").alias("features"),
    )
    return pin(rows, "vectors")


@query
def lr_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients per company and model; the last term is the intercept."""
    fits = logistic.fit_groups(_stored_vectors(spark, folder), ["permco", "model"])
    return rounded(fits.select("permco", "model", F.posexplode("beta").alias("term", "coefficient")))


@query
def lr_gradient(spark: SparkSession, folder: str) -> DataFrame:
    """Gradient of the fitted loss, which is zero in every term at the solution."""
    rows = _stored_vectors(spark, folder)
    fits = logistic.fit_groups(rows, ["permco", "model"])
    extended = F.concat("features", F.array(F.lit(1.0)))
    margin = numbers.dot(extended, F.col("beta"))
    miss = 1.0 / (1.0 + F.exp(-margin)) - F.col("label")
    parts = rows.join(fits, ["permco", "model"]).select(
        "permco", "model", miss.alias("miss"), F.size("features").alias("width"), "beta", F.posexplode(extended).alias("term", "x")
    )
    weight = F.when(F.col("term") < F.col("width"), F.get("beta", F.col("term"))).otherwise(0.0)
    sums = parts.groupBy("permco", "model", "term").agg((F.sum(F.col("miss") * F.col("x")) + F.max(weight)).alias("gradient"))
    return rounded(sums)


@query
def lr_gradient_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The same for whole vectors joined with their squares, twice as wide as Newton's method takes: spread, by gradients only."""
    rows = tables.read_table(spark, folder, "embeddings").select(
        (F.col("vec_id") % 2).alias("permco"), (F.col("label") >= 5).cast("int").alias("label"),
        F.concat("embedding", F.transform("embedding", lambda x: x * x)).cast("array<double>").alias("features"))
    rows = pin(rows, "vectors")
    fits = logistic.fit_groups(rows, ["permco"], max_group_values=1)
    extended = F.concat("features", F.array(F.lit(1.0)))
    miss = 1.0 / (1.0 + F.exp(-numbers.dot(extended, F.col("beta")))) - F.col("label")
    parts = rows.join(fits, "permco").select(
        "permco", "status", miss.alias("miss"), F.size("features").alias("width"), "beta", F.posexplode(extended).alias("term", "x"))
    weight = F.when(F.col("term") < F.col("width"), F.get("beta", F.col("term"))).otherwise(0.0)
    sums = parts.groupBy("permco", "status", "term").agg((F.sum(F.col("miss") * F.col("x")) + F.max(weight)).alias("gradient"))
    return rounded(sums, 5)


@query
def lr_status(spark: SparkSession, folder: str) -> DataFrame:
    """Status of every fit where one company has a missing value and one has a single class."""
    vector = F.col("embedding").cast("array<double>")
    broken = F.transform(vector, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))
    rows = tables.read_table(spark, folder, "embeddings").select(
        (F.col("vec_id") % 5).alias("permco"),
        F.when(F.col("vec_id") % 5 == 4, 1).otherwise((F.col("label") >= 5).cast("int")).alias("label"),
        F.when(F.col("vec_id") == 3, broken).otherwise(vector).alias("features"))
    fits = logistic.fit_groups(pin(rows, "vectors"), ["permco"])
    return fits.select("permco", "status", F.coalesce(F.size("beta"), F.lit(0)).alias("n_terms"))


@query
def walk_forward_years(spark: SparkSession, folder: str) -> DataFrame:
    """Fits over ten years and predictions of the next one, for two slices of the stored vectors in two companies and 19 years."""
    both = F.array(
        F.struct(F.lit("first16").alias("model"), F.slice("embedding", 1, 16).alias("x")),
        F.struct(F.lit("last16").alias("model"), F.slice("embedding", 49, 16).alias("x")),
    )
    rows = tables.read_table(spark, folder, "embeddings").withColumn("v", F.explode(both)).select(
        (F.col("vec_id") % 2).alias("permco"), "v.model", "vec_id", (2005 + F.col("vec_id") % 19).alias("unit"),
        (F.col("label") >= 5).cast("int").alias("label"), F.col("v.x").cast("array<double>").alias("features"))
    found = logistic.walk_forward_predict(pin(rows, "vectors"), ["permco", "model"], ["vec_id"])
    return found.select("permco", "model", "vec_id", "unit", "true_direction", "predicted_direction", "one_class", "status")


def _hex_number(text_: Column) -> Column:
    return F.conv(F.substring(F.md5(text_), 1, 15), 16, 10).cast("long")


def _trained_on_stored(spark: SparkSession, folder: str) -> tuple[trainer.Training, DataFrame]:
    """Training on the stored vectors, its shards and orders from md5, which SQL can follow."""
    rows = tables.read_table(spark, folder, "embeddings").select(
        (F.col("vec_id") % 2).alias("permco"), "vec_id", (F.col("label") >= 5).cast("int").alias("label"),
        F.slice("embedding", 1, 16).cast("array<double>").alias("features"))
    rows = pin(rows, "vectors")
    train = rows.where("vec_id % 5 < 3")
    training = trainer.train_groups(
        train, ["permco"], ["vec_id"], mix=_hex_number(F.col("vec_id").cast("string")),
        turn=lambda epoch: _hex_number(F.concat_ws(":", F.lit(str(epoch)), F.col("mix").cast("string"))))
    return training, rows.where("vec_id % 5 >= 3")


@query
def trained_values(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and classes after three passes over the stored vectors."""
    training, test = _trained_on_stored(spark, folder)
    found = trainer.predict_groups(test, training, ["permco"])
    return rounded(found.select("permco", "vec_id", "true_direction", "predicted_direction", F.get("logits", F.lit(0)).alias("down"), F.get("logits", F.lit(1)).alias("up")))


@query
def trained_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of every step and accuracy after every pass over the stored vectors."""
    training, test = _trained_on_stored(spark, folder)
    return rounded(trainer.training_log(training, test, ["permco"]))


IDS = ["ticker", "start_date", "headline"]


def _walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    return logistic.walk_forward_predict(compact_vectors(_label_rows(spark, folder)), ["permco", "model"], IDS)


@query
def walk_forward_predict(spark: SparkSession, folder: str) -> DataFrame:
    return _walk_forward(spark, folder)


@query
def walk_forward_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted rows and true ups per company, model and test quarter."""
    return _walk_forward(spark, folder).groupBy("permco", "model", "unit").agg(
        F.count("*").alias("n"), F.sum("true_direction").alias("n_up")
    )


@query
def walk_forward_risk(spark: SparkSession, folder: str) -> DataFrame:
    """From prices and news to vectors, walk-forward predictions, portfolios and the risk table."""
    predictions = pin(_walk_forward(spark, folder).select("model", "ticker", "predicted_direction"), "predictions")
    return rounded(portfolio.risk_table(portfolio_series(predictions, _pinned_weekly(spark, folder))))


def _trained(spark: SparkSession, folder: str) -> tuple[trainer.Training, DataFrame]:
    rows = _label_rows(spark, folder)
    train, test = (compact_vectors(rows.where(F.col("period") == period)) for period in ("estimation", "out_of_sample"))
    return trainer.train_groups(train, ["permco", "model"], IDS), test.wide().drop("period", "unit")


@query
def train_predict_by_group(spark: SparkSession, folder: str) -> DataFrame:
    training, test = _trained(spark, folder)
    predicted = trainer.predict_groups(test, training, ["permco", "model"])
    return predicted.select(
        "permco", "model", *IDS, "true_direction", "predicted_direction",
        F.round(F.element_at("logits", 1), 6).alias("logit_down"), F.round(F.element_at("logits", 2), 6).alias("logit_up"),
    )


@query
def train_predict_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted rows and true ups per company and model, for companies with rows in both periods."""
    training, test = _trained(spark, folder)
    return trainer.predict_groups(test, training, ["permco", "model"]).groupBy("permco", "model").agg(
        F.count("*").alias("n"), F.sum("true_direction").alias("n_up")
    )


@query
def trained_risk(spark: SparkSession, folder: str) -> DataFrame:
    """The risk table of the per-company trained models."""
    training, test = _trained(spark, folder)
    predictions = pin(trainer.predict_groups(test, training, ["permco", "model"]).select("model", "ticker", "predicted_direction"), "predictions")
    return rounded(portfolio.risk_table(portfolio_series(predictions, _pinned_weekly(spark, folder))))


@query
def training_log(spark: SparkSession, folder: str) -> DataFrame:
    training, test = _trained(spark, folder)
    return trainer.training_log(training, test, ["permco", "model"])


# ---- the whole study -------------------------------------------------------------------------------


@query
def universe_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Universe, link table, news of the week before, panel and moving average."""
    daily = views.panel_daily(spark, folder)
    listed = chain.listed_securities(daily, PERIODS)
    panel = chain.universe_panel(daily, views.news_events(spark, folder), views.link_table(spark, folder), listed, PERIODS)
    return rounded(panel.select("period", *BAR, "headline", "direction", "ma5"))


@query
def universe_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Rule models on the universe, portfolios of three companies a leg (the universe of the smallest tables has four), costs
    by the dirty size file, risk table."""
    daily = views.panel_daily(spark, folder)
    listed = chain.listed_securities(daily, PERIODS)
    weekly = bars.direction(bars.weekly_bars(universe.keep_listed(daily, listed, "permno")))
    return rounded(chain.universe_risk(daily, views.rule_votes(weekly), _size_input(spark, folder), listed, PERIODS, leg_size=3))


# ---- one model for all texts -----------------------------------------------------------------------

POOLED_BUCKETS = 4096


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quality class; even ids are for training."""
    labels = tables.read_table(spark, folder, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return tables.read_table(spark, folder, "documents").select("doc_id", "lang", "text").join(labels, "doc_id")


def _pooled(spark: SparkSession, folder: str) -> tuple[pooled.PipelineModel, DataFrame]:
    rows = _labelled(spark, folder)
    train = pin(rows.where("doc_id % 2 = 0").repartition("doc_id"), "pooled-train")
    return pooled.fit_pooled(train, "text", "label", buckets=POOLED_BUCKETS), train


@query
def train_predict_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """Test documents by language and class, with those that got a class and a chance."""
    model, _ = _pooled(spark, folder)
    found = pooled.predict_pooled(model, _labelled(spark, folder).where("doc_id % 2 = 1"), "text")
    scored = F.col("predicted_direction").isin(0, 1) & ((F.col("chance") > 0.5) == (F.col("predicted_direction") == 1))
    return found.groupBy("lang", "label").agg(F.count("*").alias("n"), F.count_if(scored).alias("n_scored"))


@query
def pooled_idf(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency and weight of every hash bucket in the training documents."""
    model, _ = _pooled(spark, folder)
    return rounded(pooled.bucket_weights(model).select("bucket", "documents", "idf"))


@query
def pooled_gradient(spark: SparkSession, folder: str) -> DataFrame:
    """Gradient of the fitted loss in every bucket that occurs, from the published coefficients: zero at the solution."""
    model, train = _pooled(spark, folder)
    weights, intercept = pooled.bucket_weights(model), float(model.stages[3].intercept)
    entries = pin(pooled.cells(model, train, "text", ["doc_id", "label"]), "cells")
    margins = pooled.margins(entries, weights, ["doc_id"], intercept)
    miss = 1.0 / (1.0 + F.exp(-F.col("margin"))) - F.col("label")
    sums = entries.join(margins, "doc_id").groupBy("bucket").agg(F.sum(miss * F.col("value")).alias("s"))
    gradient = F.col("s") / train.count() + pooled.REGULARIZATION * F.col("weight")
    return rounded(sums.join(weights, "bucket").select("bucket", gradient.alias("gradient")), 4)


@query
def pooled_class(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every test document under published coefficients, a fixed rule of the bucket number here."""
    model, _ = _pooled(spark, folder)
    weights = spark.range(POOLED_BUCKETS).select(F.col("id").cast("int").alias("bucket"), ((F.col("id") * 37 % 101 - 50) / 100.0).alias("weight"))
    entries = pooled.cells(model, _labelled(spark, folder).where("doc_id % 2 = 1"), "text", ["doc_id"])
    margins = pooled.margins(entries, weights, ["doc_id"], 0.25)
    return rounded(margins.select("doc_id", "margin", (F.col("margin") > 0).cast("int").alias("predicted")))
