"""Barrier labels: which barrier is touched first in the window after each bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Barriers, Layout
from barloom.operators.series import Blocks, with_position
from barloom.operators.touches import SIDES, first_touches


def bars_ahead(blocks: Blocks, window: int) -> Column:
    """Position, high and low of the next ``window`` bars, fewer at the end of the series."""
    return F.collect_list(F.struct("pos", "high", "low")).over(blocks.rows.rowsBetween(1, window))


def first_touch(ahead: Column, entry: Column, barriers: Barriers, side: int) -> Column:
    """First of the bars ahead that reaches the target or the stop of a long (1) or short (-1)."""
    if side > 0:
        upper, lower = entry + barriers.target_distance, entry - barriers.stop_distance
    else:
        upper, lower = entry + barriers.stop_distance, entry - barriers.target_distance
    touched = F.filter(ahead, lambda bar: (bar["high"] >= upper) | (bar["low"] <= lower))
    return F.get(touched, F.lit(0))


def wins(touch: Column, entry: Column, barriers: Barriers, side: int) -> Column:
    """Whether the touching bar leaves the stop alone; on a bar that reaches both, the stop wins."""
    if side > 0:
        clear = touch["low"] > entry - barriers.stop_distance
    else:
        clear = touch["high"] < entry + barriers.stop_distance
    return F.coalesce(clear, F.lit(False))


def add_target(df: DataFrame, blocks: Blocks, barriers: Barriers, name: str = "Target") -> DataFrame:
    """Add the label to rows spread over ``blocks``: 1, -1, 0, or NULL without a full window."""
    entry = F.col("close")
    touched = df.withColumn("_ahead", bars_ahead(blocks, barriers.window)).withColumns(
        {
            "_long": wins(first_touch(F.col("_ahead"), entry, barriers, 1), entry, barriers, 1),
            "_short": wins(first_touch(F.col("_ahead"), entry, barriers, -1), entry, barriers, -1),
        }
    )
    label = label_of(F.size("_ahead") == barriers.window, F.col("_long"), F.col("_short"))
    return touched.withColumn(name, label).drop("_ahead", "_long", "_short")


def label_of(full: Column, long: Column, short: Column) -> Column:
    """1 or -1 where that side alone wins, 0 otherwise, NULL without a full window."""
    return (
        F.when(~full, F.lit(None).cast("int"))
        .when(long & ~short, F.lit(1))
        .when(short & ~long, F.lit(-1))
        .otherwise(F.lit(0))
    )


def triple_barrier_label(
    bars: DataFrame,
    barriers: Barriers = Barriers(),
    keys: Sequence[str] = ("symbol", "timeframe"),
    layout: Layout = Layout(),
    name: str = "Target",
    positions: str = "count",
) -> DataFrame:
    """Label every bar; the last ``window`` bars of a series keep NULL."""
    blocks = Blocks(tuple(keys), 0, barriers.window, layout)
    spread = blocks.spread(with_position(bars, keys, layout, positions=positions), positions)
    if barriers.window > layout.list_window:
        found = first_touches(spread, blocks, barriers, SIDES)
        full = F.col("_seen") == barriers.window
        return found.withColumn(name, label_of(full, F.col("_won_long"), F.col("_won_short"))).select(
            *bars.columns, name
        )
    labelled = blocks.own_rows(add_target(spread, blocks, barriers, name))
    return labelled.select(*bars.columns, name)


def drop_unlabelled_tail(labelled: DataFrame, name: str = "Target") -> DataFrame:
    return labelled.dropna(subset=[name])


def label_distribution(
    labelled: DataFrame, keys: Sequence[str] = ("symbol",), name: str = "Target"
) -> DataFrame:
    """Share of each class in percent, the share itself rounded to 4 digits."""
    counts = labelled.dropna(subset=[name]).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    share = F.bround(F.col("n") / total, 4) * 100
    return counts.withColumn("share_pct", F.round(share, 2))
