"""Long/short portfolios from prediction scores, and their risk tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.params import LEG_SIZE, PORTFOLIO_TYPES, RISK_FREE
from tickerloom.session import pin

BROADCAST_ROWS = 100_000  # weights up to this number are broadcast, more are joined by a shuffle


def ticker_scores(predictions: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """Mean predicted direction per model and ticker, for tickers that have returns."""
    rows = predictions
    if returns is not None:
        rows = rows.join(returns.select("ticker").distinct(), "ticker", "left_semi")
    return rows.groupBy("model", "ticker").agg(F.avg("predicted_direction").alias("score"))


def long_short_picks(scores: DataFrame, size: int = LEG_SIZE) -> DataFrame:
    """(model, ticker, score, leg): the ``size`` highest scores are long, the lowest short.

    Order is by score, then ticker.  The two legs are separate rank filters, so each task keeps only
    ``size`` rows per model before the shuffle.  A short list of tickers may put a ticker in both legs.
    """

    def leg(name: str, *order: Column) -> DataFrame:
        ranked = scores.withColumn("leg_rank", F.row_number().over(Window.partitionBy("model").orderBy(*order)))
        return ranked.where(F.col("leg_rank") <= size).withColumn("leg", F.lit(name))

    top = leg("long", F.desc("score"), F.desc("ticker"))
    bottom = leg("short", F.asc("score"), F.asc("ticker"))
    return top.unionByName(bottom)


def portfolio_weights(picks: DataFrame) -> DataFrame:
    """Equal weights and score-proportional weights inside a leg; a leg with score sum 0 has no value weights."""
    leg = Window.partitionBy("model", "leg")
    return picks.withColumns({
        "ew": F.lit(1.0) / F.count("*").over(leg),
        "vw": F.try_divide(F.col("score"), F.sum("score").over(leg)),
    })


def portfolio_returns(weights: DataFrame, returns: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """(model, scenario, type, week, ret) for six portfolios; a missing return counts as 0.

    The models are those of ``weights``, which are written once.  Weeks without any picked ticker still appear, with 0; a model without picks
    does not appear.
    """
    # Two legs of the leg size per model, evaluated once; both legs meet the returns in one order, so equal legs cancel exactly.
    held = pin(weights.select("model", "ticker", "leg", "ew", "vw"), "weights")
    models = held.where("model is not null").select("model").distinct()
    if held.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    parts = {
        "ew_l": F.when(F.col("leg") == "long", F.col("ew") * F.col("ret")),
        "ew_s": F.when(F.col("leg") == "short", F.col("ew") * F.col("ret")),
        "vw_l": F.when(F.col("leg") == "long", F.col("vw") * F.col("ret")),
        "vw_s": F.when(F.col("leg") == "short", F.col("vw") * F.col("ret")),
    }
    earned = returns.join(held, "ticker").groupBy("model", "scenario", "week").agg(
        *[F.sum(value).alias(name) for name, value in parts.items()]
    )
    # Every model meets every week of every scenario; the calendar bounds the list of weeks.
    named = F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario")
    weeks = returns.select("week").distinct().select("week", named).groupBy("scenario").agg(F.collect_set("week").alias("weeks"))
    every_week = models.select("model", named).join(weeks, "scenario").select("model", "scenario", F.explode("weeks").alias("week"))
    filled = every_week.join(earned, ["model", "scenario", "week"], "left").na.fill(0.0, list(parts))
    wide = filled.select(
        "model", "scenario", "week",
        F.col("ew_l").alias("EW L"), F.col("ew_s").alias("EW S"), (F.col("ew_l") - F.col("ew_s")).alias("EW LS"),
        F.col("vw_l").alias("VW L"), F.col("vw_s").alias("VW S"), (F.col("vw_l") - F.col("vw_s")).alias("VW LS"),
    )
    return wide.unpivot(["model", "scenario", "week"], list(PORTFOLIO_TYPES), "type", "ret")


def sharpe(ret: Column, risk_free: float = RISK_FREE) -> Column:
    """Aggregate: mean excess return over its sample deviation; null for a deviation of 0."""
    excess = ret - F.lit(risk_free)
    return F.try_divide(F.avg(excess), F.stddev_samp(excess))


def risk_table(series: DataFrame, keys: Sequence[str] = ("model", "scenario", "type")) -> DataFrame:
    """Mean, sample deviation and Sharpe ratio of each return series."""
    ret = F.col("ret")
    return series.groupBy(*keys).agg(F.avg(ret).alias("ret"), F.stddev_samp(ret).alias("std"), sharpe(ret).alias("sr"))


def risk_table_wide(risk: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per scenario and type, columns ``Return m``, ``Std m``, ``SR m`` per model, three decimals.

    ``models`` gives the order of the columns; a model outside it is an error.
    """
    unlisted = F.raise_error(F.concat(F.lit("model without a column: "), F.col("model")))
    listed = F.when(F.col("model").isin(list(models)), F.col("model")).otherwise(unlisted)
    wide = risk.withColumn("model", listed).groupBy("scenario", "type").pivot("model", list(models)).agg(
        F.round(F.first("ret"), 3).alias("Return"), F.round(F.first("std"), 3).alias("Std"), F.round(F.first("sr"), 3).alias("SR")
    )
    cells = [F.col(f"`{m}_{name}`").alias(f"{name} {m}") for m in models for name in ("Return", "Std", "SR")]
    return wide.select(F.col("scenario").alias("Scenario"), F.col("type").alias("Type"), *cells).orderBy("Scenario", "Type")


def sharpe_by_model(series: DataFrame, market: DataFrame) -> DataFrame:
    """One row per model: Sharpe ratio of each portfolio type, and of the market."""
    names = {kind: kind.lower().replace(" ", "_") for kind in PORTFOLIO_TYPES}
    table = series.groupBy("model").pivot("type", list(PORTFOLIO_TYPES)).agg(sharpe(F.col("ret")))
    market_sharpe = market.agg(sharpe(F.col("ret")).alias("sr")).scalar()
    return table.select("model", *[F.col(f"`{kind}`").alias(name) for kind, name in names.items()], market_sharpe.alias("market"))


def cumulative_returns(series: DataFrame, keys: Sequence[str], day: str = "week") -> DataFrame:
    """Compounded return from the first week on; a window holds the weeks of one series."""
    along = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("cum_ret", F.product(1.0 + F.col("ret")).over(along) - 1.0)
