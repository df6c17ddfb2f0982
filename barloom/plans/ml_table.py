"""The labelled feature table of every symbol."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import ML_COLUMNS, Barriers, Indicators, Layout
from barloom.operators.asof import RightSide, asof_backward, asof_by_time
from barloom.operators.indicators import add_indicators, base_features, log_returns
from barloom.operators.labels import drop_unlabelled_tail


@dataclass(frozen=True)
class Series:
    """Which timeframes and side symbols feed the table.

    ``macro`` maps a side symbol to its column. The lags, in hours, delay the coarser bars and
    the side bars until they are complete; 0 matches them by their stamped time.
    """

    base: str = "H1"
    middle: str = "H4"
    coarse: str = "D1"
    macro: tuple[tuple[str, str], ...] = (("XAUUSD", "XAU_Return"), ("USDCHF", "CHF_Return"))
    middle_lag: float = 0.0
    coarse_lag: float = 0.0
    macro_lag: float = 0.0


def labelled_features(
    bars: DataFrame,
    series: Series,
    barriers: Barriers,
    spec: Indicators = Indicators(),
    layout: Layout = Layout(),
    positions: str = "count",
) -> DataFrame:
    """Base bars with label and indicators, unlabelled tail removed, computed in one pass."""
    columns = [
        "Log_Return",
        *[f"Dist_EMA_{n}" for n in spec.emas],
        f"RSI_{spec.rsi}",
        f"ADX_{spec.adx}",
        "ATR_Norm",
        "BB_Width",
        "Hour_Sin",
        "Hour_Cos",
    ]
    base = bars.where(F.col("timeframe") == series.base)
    labelled = add_indicators(
        base, columns, spec, layout=layout, label=barriers, positions=positions
    )
    return drop_unlabelled_tail(labelled)


def merged_features(
    bars: DataFrame,
    series: Series,
    barriers: Barriers,
    spec: Indicators = Indicators(),
    layout: Layout = Layout(),
    positions: str = "count",
) -> DataFrame:
    """Labelled features with the coarser timeframes and the side symbols as of each bar."""
    left = labelled_features(bars, series, barriers, spec, layout, positions)
    rights = []
    for timeframe, suffix, lag in (
        (series.middle, "_H4", series.middle_lag),
        (series.coarse, "_D1", series.coarse_lag),
    ):
        coarse = bars.where(F.col("timeframe") == timeframe)
        feats = base_features(coarse, suffix, spec, layout=layout, positions=positions).drop("timeframe")
        payload = tuple(c for c in feats.columns if c not in ("symbol", "time"))
        rights.append(RightSide(feats, payload, lag))
    times = bars.where(F.col("timeframe") == series.base).select("symbol", "time")
    joined = asof_backward(left, rights, ["symbol"], layout, times)
    return asof_by_time(joined, macro_sides(bars, series, layout, positions), layout, times)


def macro_sides(
    bars: DataFrame, series: Series, layout: Layout = Layout(), positions: str = "count"
) -> list[RightSide]:
    sides = []
    for symbol, column in series.macro:
        side = bars.where((F.col("timeframe") == series.base) & (F.col("symbol") == symbol))
        returns = log_returns(side, layout=layout, name=column, positions=positions)
        sides.append(RightSide(returns.select("time", column), (column,), series.macro_lag))
    return sides


def drop_incomplete(merged: DataFrame) -> DataFrame:
    """Remove rows with a missing value in any column, those not kept later included."""
    return merged.dropna()


def project(merged: DataFrame, columns: Sequence[str] = ML_COLUMNS) -> DataFrame:
    return merged.select("symbol", "time", *columns)


def ml_table(
    bars: DataFrame,
    series: Series = Series(),
    barriers: Barriers = Barriers(),
    spec: Indicators = Indicators(),
    layout: Layout = Layout(),
    positions: str = "count",
) -> DataFrame:
    return project(drop_incomplete(merged_features(bars, series, barriers, spec, layout, positions)))
