"""Predictions and prices to portfolio return series and risk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickerloom.operators.portfolio import long_short_picks, portfolio_returns, portfolio_weights, risk_table, ticker_scores
from tickerloom.operators.returns import by_scenario, net_returns, period_return, size_class, weekly_compound
from tickerloom.params import GROSS, LEG_SIZE, NET
from tickerloom.session import pin


def weekly_returns(panel: DataFrame, daily: DataFrame, cost_per_row: bool = False) -> DataFrame:
    """(week, ticker, ret, net_ret) of a panel, costs by the size class of the day the week starts."""
    return weekly_compound(net_returns(period_return(panel), size_class(daily), cost_per_row))


def portfolio_series(predictions: DataFrame, weekly: DataFrame, leg_size: int = LEG_SIZE) -> DataFrame:
    """Six portfolios per model and cost scenario, for any prediction set (model, ticker, predicted_direction).

    ``weekly`` is read several times: pass a pinned table.
    """
    returns = by_scenario(weekly)
    scores = pin(ticker_scores(predictions, weekly), "scores")  # one row per model and ticker, ranked twice
    picks = long_short_picks(scores, leg_size)
    return portfolio_returns(portfolio_weights(picks), returns, [GROSS, NET])


def risk_report(predictions: DataFrame, weekly: DataFrame, leg_size: int = LEG_SIZE) -> DataFrame:
    return risk_table(portfolio_series(predictions, weekly, leg_size))
