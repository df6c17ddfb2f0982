"""From predictions to trades, metrics and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from barloom.config import Account, Barriers, Layout
from barloom.functions.trading import Weight, weight_default
from barloom.operators.events import (
    first_passage,
    join_features,
    join_prices,
    non_overlapping_events,
    trade_pnl,
    with_signals,
)
from barloom.operators.metrics import metrics_record, with_ratios


@dataclass(frozen=True)
class Rules:
    """Everything that decides which trades happen and what they earn."""

    barriers: Barriers = Barriers()
    account: Account = Account()
    threshold: float = 0.45
    weight: Weight = weight_default


def evaluation_inputs(
    predictions: DataFrame, bars: DataFrame, features: DataFrame, threshold: float = 0.45
) -> DataFrame:
    """Predictions with prices, features, year and signal; read by every later step."""
    return with_signals(join_features(join_prices(predictions, bars), features), threshold)


def priced_trades(inputs: DataFrame, rules: Rules = Rules(), layout: Layout = Layout()) -> DataFrame:
    events = first_passage(inputs, rules.barriers, layout=layout)
    kept = non_overlapping_events(events, rules.barriers.window)
    return trade_pnl(kept, rules.barriers, rules.account, rules.weight)


def evaluation(inputs: DataFrame, rules: Rules = Rules(), layout: Layout = Layout()) -> DataFrame:
    """Metrics per (symbol, year) with expectancy and signal ratio."""
    trades = priced_trades(inputs, rules, layout)
    return with_ratios(metrics_record(trades, inputs, rules.barriers, rules.account))
