"""Indicators of new bars without the history of their series.

What later bars need of a series is one row: the last bars, as many as the trailing windows and
differences look back on, and every exponential sum at the first of them. New bars are put behind
these bars, the sums go on from where they stood, and the last bars give the state for the bars after
them. A series that is still shorter than the starts of its means keeps all of its bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import Indicators, Layout
from barloom.operators.indicators import indicator_blocks, indicator_columns, wanted
from barloom.operators.series import with_position
from barloom.session import stored

SERIES = ("symbol", "timeframe")


def bars_kept(columns: Sequence[str], spec: Indicators) -> tuple[int, int]:
    """How many last bars a state keeps, and the last position at which a mean may start."""
    return max(spec.bollinger, 2) + 1, max([*wanted(columns, spec)[0], spec.rsi, spec.atr, spec.adx]) + 1


def behind(state: DataFrame, bars: DataFrame, keys: Sequence[str], layout: Layout) -> DataFrame:
    """The kept bars of the state and the new ones, numbered on from the last position; every row
    knows the sums of its series. A new bar that does not follow the last one is an error."""
    last = state.select(*keys, F.col("pos").alias("_last"), F.col("last_time").alias("_last_time"))
    after = with_position(bars, keys, layout).withColumn("_new", F.lit(True)).join(last, list(keys), "left")
    late = F.raise_error(F.lit("a new bar does not follow the bars of its series"))
    place = F.col("pos") + F.coalesce(F.col("_last") + 1, F.lit(0))
    after = after.withColumn("pos", F.when(F.col("time") <= F.col("_last_time"), late.cast("long")).otherwise(place))
    before = state.select(*keys, F.inline("tail")).withColumn("_new", F.lit(False))
    names = [*keys, "pos", "_new", *[c for c in bars.columns if c not in (*keys, "pos")]]
    sums = [c for c in state.columns if c == "_at" or c.startswith("_c")]
    return after.select(*names).unionByName(before.select(*names)).join(state.select(*keys, *sums), list(keys), "left")


def add_to_indicators(
    bars: DataFrame,
    columns: Sequence[str],
    state: DataFrame | None = None,
    spec: Indicators = Indicators(),
    keys: Sequence[str] = SERIES,
    layout: Layout = Layout(),
) -> tuple[DataFrame, DataFrame]:
    """The bars with the named columns (see ``add_indicators``), and the state after them.

    Without a state the bars are the beginnings of their series. With the state returned for all bars
    before, only the new bars are given, later than those; results are the same as for the whole
    series but for the last digits. Series without new bars stay as they are in the state, new series
    begin. Means that start with a plain mean of many values (``wilder_start`` "sma") are not kept.
    """
    if spec.wilder_start == "sma":
        raise ValueError("sums that start with a plain mean are not carried over")
    keys, (many, start) = list(keys), bars_kept(columns, spec)
    if state is None:
        rows = with_position(bars, keys, layout).withColumn("_new", F.lit(True))
    else:
        rows = behind(state, bars, keys, layout)
    blocks = indicator_blocks(columns, spec, keys, layout)
    done = indicator_columns(blocks.spread(rows), blocks, columns, spec, carried=state is not None, keep=True)
    own = [c for c in bars.columns if c not in (*keys, "pos")]
    sums = [c for c in done.columns if c.startswith("_k") or c in ("_rsi_move", "_adx_move")]
    done = stored(blocks.own_rows(done).select(*keys, "pos", "_new", *own, *columns, *sums))

    ends = done.groupBy(*keys).agg(F.max("pos").alias("_last"))
    first = F.col("_last") - many + 1
    ends = ends.select(*keys, F.when(first > start, first).alias("_at"))
    last = done.join(ends, keys).where(F.col("pos") >= F.coalesce("_at", F.lit(0)))
    here = F.col("pos") == F.col("_at")
    after = last.groupBy(*keys).agg(
        F.max("pos").alias("pos"),
        F.max("time").alias("last_time"),
        F.max("_at").alias("_at"),
        F.sort_array(F.collect_list(F.struct("pos", *own))).alias("tail"),
        *[F.max(F.when(here, F.col(c))).alias(f"_c{c[2:] if c.startswith('_k') else c}") for c in sums],
    )
    return done.where("_new").select(*keys, *own, *columns), after
