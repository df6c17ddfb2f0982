"""Metrics of trades per key, by default per (symbol, year)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Account, Barriers
from barloom.functions.clock import day_of
from barloom.functions.trading import expectancy, or_zero, pips_to_return, signal_ratio
from barloom.operators.events import YEARLY
from barloom.operators.series import FIRST, NOW

METRICS = (
    "profit_net",
    "dd",
    "win_rate",
    "sharpe",
    "pips_sharpe",
    "total_return_pct",
    "max_dd_pct",
    "bh_pips",
    "bh_return_pct",
    "alpha_pips",
    "alpha_return_pct",
)
TRADING_DAYS = 252


def _running(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running sum and running maximum of net pips inside each day."""
    inside = Window.partitionBy(*keys, "_day").orderBy("time").rowsBetween(FIRST, NOW)
    days = trades.withColumn("_day", day_of(F.col("time"))).repartition(*keys, "_day")
    return days.withColumn("_sum", F.sum("net").over(inside)).withColumn(
        "_top", F.max("_sum").over(inside)
    )


def _levels(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the level and the peak that the earlier days leave behind.

    A key has at most one row per calendar day here, so the window over days is small.
    """
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(FIRST, -1)
    return days.withColumn("_before", or_zero(F.sum("pnl").over(earlier))).withColumn(
        "_peak_before", F.max(F.col("_before") + F.col("_peak")).over(earlier)
    )


def _days(running: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per day from the running sums of its trades."""
    days = running.groupBy(*keys, "_day").agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(F.col("gross") > 0).alias("wins"),
        F.sum("net").alias("pnl"),
        F.max("_sum").alias("_peak"),
        F.min("_sum").alias("_low"),
        F.min(F.col("_sum") - F.col("_top")).alias("_drop"),
    )
    return _levels(days, keys)


def daily_by_place(trades: DataFrame, nets: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """One row per day and ``place`` in ``nets``, ways to count the net pips of the same trades.

    All of them are summed side by side, so trades are shuffled once; only day rows are repeated.
    """
    inside = Window.partitionBy(*keys, "_day").orderBy("time").rowsBetween(FIRST, NOW)
    days = trades.withColumn("_day", day_of(F.col("time"))).repartition(*keys, "_day")
    days = days.withColumns({f"_net{n}": net for n, net in enumerate(nets)})
    days = days.withColumns({f"_sum{n}": F.sum(f"_net{n}").over(inside) for n in range(len(nets))})
    days = days.withColumns({f"_top{n}": F.max(f"_sum{n}").over(inside) for n in range(len(nets))})
    sums = []
    for n in range(len(nets)):
        total = F.col(f"_sum{n}")
        sums += [
            F.sum(f"_net{n}").alias(f"_pnl{n}"),
            F.max(total).alias(f"_peak{n}"),
            F.min(total).alias(f"_low{n}"),
            F.min(total - F.col(f"_top{n}")).alias(f"_drop{n}"),
        ]
    rows = [
        F.struct(
            F.lit(n).alias("place"),
            F.col(f"_pnl{n}").alias("pnl"),
            *[F.col(f"_{c}{n}").alias(f"_{c}") for c in ("peak", "low", "drop")],
        )
        for n in range(len(nets))
    ]
    counts = (F.count(F.lit(1)).alias("trades"), F.count_if(F.col("gross") > 0).alias("wins"))
    wide = days.groupBy(*keys, "_day").agg(*counts, *sums)
    return wide.select(*keys, "_day", "trades", "wins", F.inline(F.array(*rows)))


def equity_curve(trades: DataFrame, keys: Sequence[str] = YEARLY) -> DataFrame:
    """Trades with the running sum of net pips, its running maximum and the drawdown."""
    running = _running(trades, keys)
    start = _days(running, keys).select(*keys, "_day", "_before", "_peak_before")
    equity = F.col("_before") + F.col("_sum")
    peak = F.greatest(F.col("_before") + F.col("_top"), F.col("_peak_before"))
    return (
        running.join(start, [*keys, "_day"])
        .withColumns({"equity": equity, "peak": peak, "drawdown": equity - peak})
        .drop("_day", "_sum", "_top", "_before", "_peak_before")
    )


def daily_pnl(trades: DataFrame, keys: Sequence[str] = YEARLY) -> DataFrame:
    """Net pips per calendar day from the first to the last entry, 0 on days without a trade."""
    days = trades.groupBy(*keys, day_of(F.col("time")).alias("day")).agg(F.sum("net").alias("pnl"))
    following = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
    gap = F.coalesce(F.datediff(following, "day") - 1, F.lit(0))
    values = F.concat(F.array("pnl"), F.array_repeat(F.lit(0.0), gap))
    return (
        days.withColumn("_values", values)
        .select(*keys, "day", F.posexplode("_values").alias("_n", "pnl"))
        .select(*keys, F.date_add("day", F.col("_n")).cast("timestamp_ntz").alias("day"), "pnl")
    )


def per_key(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything that needs the trades only."""
    return per_days(_days(_running(trades, keys), keys), keys)


def per_place(trades: DataFrame, nets: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """The same for several ways to count the net pips, ``place`` being a key of the result."""
    placed = [*keys, "place"]
    return per_days(_levels(daily_by_place(trades, nets, keys), placed), placed)


def per_days(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics from one row per day.

    The mean and deviation of the daily sums count the empty days between the first and the last
    entry as zeros: n zeros next to k values of mean m add m * m * k * n / (k + n) to the sum of
    squared deviations.
    """
    drop = F.least(F.col("_drop"), F.col("_before") + F.col("_low") - F.col("_peak_before"))
    sums = (
        days.withColumn("_worst", drop)
        .groupBy(*keys)
        .agg(
            F.sum("trades").alias("trades"),
            F.sum("wins").alias("wins"),
            F.sum("pnl").alias("profit_net"),
            F.min("_worst").alias("dd"),
            F.count(F.lit(1)).alias("_k"),
            F.avg("pnl").alias("_mean"),
            (F.var_pop("pnl") * F.count(F.lit(1))).alias("_squares"),
            (F.datediff(F.max("_day"), F.min("_day")) + 1).alias("days"),
        )
    )
    empty = F.col("days") - F.col("_k")
    squares = F.col("_squares") + F.col("_mean") * F.col("_mean") * F.col("_k") * empty / F.col("days")
    deviation = F.sqrt(F.try_divide(squares, F.col("days") - 1.0))
    ratio = F.try_divide(F.col("profit_net") / F.col("days"), deviation) * math.sqrt(TRADING_DAYS)
    return (
        sums.withColumn("pips_sharpe", or_zero(F.when(F.col("days") > 1, ratio)))
        .withColumn("win_rate", F.col("wins") / F.col("trades") * 100)
        .drop("_k", "_mean", "_squares")
    )


def win_rate_profit(trades: DataFrame, keys: Sequence[str] = YEARLY) -> DataFrame:
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        (F.avg((F.col("gross") > 0).cast("double")) * 100).alias("win_rate"),
        F.sum("net").alias("profit_net"),
    )


def max_drawdown(trades: DataFrame, keys: Sequence[str] = YEARLY) -> DataFrame:
    return per_key(trades, keys).select(*keys, "dd")


def sharpe(trades: DataFrame, keys: Sequence[str] = YEARLY) -> DataFrame:
    """Annualised mean over deviation of the daily sums; 0 for one day or no deviation.

    Turning pips into returns scales mean and deviation alike, so both ratios are the same.
    """
    return per_key(trades, keys).select(
        *keys, "days", F.col("pips_sharpe").alias("sharpe"), "pips_sharpe"
    )


def hold_pips(barriers: Barriers) -> Column:
    """Pips between the first and the last known close; 0 with fewer than two."""
    known = F.when(F.col("close").isNotNull(), F.col("time"))
    change = (F.max_by("close", known) - F.min_by("close", known)) / barriers.pip_size
    return F.when(F.count("close") >= 2, change).otherwise(F.lit(0.0))


def buy_and_hold(
    inputs: DataFrame, barriers: Barriers = Barriers(), keys: Sequence[str] = YEARLY
) -> DataFrame:
    return inputs.groupBy(*keys).agg(hold_pips(barriers).alias("bh_pips"))


def metrics_record(
    trades: DataFrame,
    inputs: DataFrame,
    barriers: Barriers = Barriers(),
    account: Account = Account(),
    keys: Sequence[str] = YEARLY,
) -> DataFrame:
    """One row per key with input; without trades every metric is 0, buy and hold included."""
    totals = input_totals(inputs, barriers, keys)
    return finish_record(totals.join(per_key(trades, keys), list(keys), "left"), account, keys)


def input_totals(inputs: DataFrame, barriers: Barriers, keys: Sequence[str] = YEARLY) -> DataFrame:
    """Signals and buy-and-hold pips of the input rows."""
    return inputs.groupBy(*keys).agg(
        F.count_if(F.col("signal") != 0).alias("n_signals"), hold_pips(barriers).alias("_bh")
    )


def finish_record(joined: DataFrame, account: Account, keys: Sequence[str]) -> DataFrame:
    """Zero defaults and derived fields on input totals left-joined with the trade metrics."""
    traded = F.col("trades").isNotNull()
    joined = joined.withColumn("bh_pips", F.when(traded, F.col("_bh")))
    joined = joined.withColumns(
        {
            "sharpe": F.col("pips_sharpe"),
            "total_return_pct": pips_to_return(F.col("profit_net"), account) * 100,
            "max_dd_pct": pips_to_return(F.col("dd"), account) * 100,
            "bh_return_pct": pips_to_return(F.col("bh_pips"), account) * 100,
            "alpha_pips": F.col("profit_net") - F.col("bh_pips"),
        }
    ).withColumn("alpha_return_pct", F.col("total_return_pct") - F.col("bh_return_pct"))
    return joined.select(
        *keys,
        F.coalesce("trades", F.lit(0)).cast("bigint").alias("trades"),
        *[or_zero(F.col(c)).alias(c) for c in METRICS],
        "n_signals",
    )


def with_ratios(metrics: DataFrame) -> DataFrame:
    """Profit per trade and signals per trade, 0 without trades."""
    return metrics.withColumns({"expectancy": expectancy(), "signal_ratio": signal_ratio()})


def yearly_summary(metrics: DataFrame) -> DataFrame:
    """Every metric per symbol and year, and totals: one row per symbol with the year left empty, and
    one row with both left empty over all symbols.

    Trades, signals and profit are summed, the drawdown is the worst of the years; ratios of years
    do not add up and are empty in the totals.
    """
    whole = ("trades", "n_signals", "profit_net")
    ratios = [c for c in metrics.columns if c not in ("symbol", "year", "dd", *whole)]
    of_year = F.grouping("year") == 0
    return metrics.rollup("symbol", "year").agg(
        *[F.sum(c).alias(c) for c in whole],
        F.min("dd").alias("dd"),
        *[F.when(of_year, F.max(c)).alias(c) for c in ratios],
    )
