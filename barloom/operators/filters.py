"""Row filters, time splits and column selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import DROPPED_FEATURES, Layout, Split
from barloom.functions.clock import shift_hours, year_start
from barloom.operators.series import Blocks, with_position

KEY_COLUMNS = ("symbol", "timeframe", "time", "year")


def train_cutoff(split: Split) -> Column:
    return shift_hours(year_start(split.train_end + 1), -split.purge_hours)


def purged_train_split(
    df: DataFrame, split: Split = Split(), keys: Sequence[str] = ("symbol",), layout: Layout = Layout()
) -> DataFrame:
    """Rows before the end of the training span, less the purge, by hours or by bars."""
    if split.purge_bars is None:
        return df.where(F.col("time") < train_cutoff(split))
    inside = df.where(F.col("time") < year_start(split.train_end + 1))
    blocks = Blocks(tuple(keys), 0, split.purge_bars, layout)
    spread = blocks.spread(with_position(inside.drop("pos"), keys, layout))
    later = F.count(F.lit(1)).over(blocks.rows.rowsBetween(1, split.purge_bars))
    kept = spread.withColumn("_later", later).where(F.col("_later") == split.purge_bars)
    return blocks.own_rows(kept).select(*df.columns)


def require_rows(df: DataFrame, split: Split) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no training rows up to {split.train_end}")
    return df


def year_slice(df: DataFrame, years: Iterable[int]) -> DataFrame:
    """Rows of the given years, with the year as a column.

    The range condition on the time reaches the scan; the year alone would not.
    """
    years = sorted(years)
    wanted = [(F.col("time") >= year_start(y)) & (F.col("time") < year_start(y + 1)) for y in years]
    condition = wanted[0]
    for more in wanted[1:]:
        condition = condition | more
    return df.where(condition).withColumn("year", F.year("time"))


def feature_columns(
    df: DataFrame,
    exclude: Iterable[str] = ("Target", "Spread"),
    dropped: Iterable[str] = DROPPED_FEATURES,
) -> list[str]:
    """All columns but the keys, the excluded ones and the dropped features, in table order."""
    out = {*KEY_COLUMNS, *exclude, *dropped}
    return [c for c in df.columns if c not in out]


def importance_filter(importance: DataFrame, times_sd: float = 2.0) -> DataFrame:
    """Features whose mean loss under permutation is at least ``times_sd`` deviations."""
    return importance.where(
        F.col("permutation_mean") >= F.col("permutation_std") * times_sd
    )


def losers(trades: DataFrame) -> DataFrame:
    return trades.where(F.col("net") < 0)


def winners(trades: DataFrame) -> DataFrame:
    return trades.where(F.col("net") > 0)
