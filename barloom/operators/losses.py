"""What separates winning from losing trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.events import YEARLY


def loss_breakdown(trades: DataFrame, keys: Sequence[str] = YEARLY) -> DataFrame:
    """Trades, losses, winners by net pips in percent, and losses by how they ended."""
    lost = F.col("net") < 0
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(lost).alias("losses"),
        (F.avg((F.col("net") > 0).cast("double")) * 100).alias("win_pct"),
        F.count_if(lost & (F.col("result") == "loss_sl")).alias("losses_stop"),
        F.count_if(lost & (F.col("result") == "loss_timeout")).alias("losses_timeout"),
    )


def mean_gap_top(
    trades: DataFrame, features: Sequence[str], keys: Sequence[str] = YEARLY, top: int = 5
) -> DataFrame:
    """The features whose means differ most between winners and losers, ties in column order.

    Both means of every feature come from one aggregation; only its few rows are turned around.
    """
    won, lost = F.col("net") > 0, F.col("net") < 0
    means = trades.groupBy(*keys).agg(
        *[F.avg(F.when(won, F.col(c))).alias(f"_w{n}") for n, c in enumerate(features)],
        *[F.avg(F.when(lost, F.col(c))).alias(f"_l{n}") for n, c in enumerate(features)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(n).alias("place"),
                F.col(f"_w{n}").alias("mean_win"),
                F.col(f"_l{n}").alias("mean_loss"),
            )
            for n, c in enumerate(features)
        ]
    )
    gaps = (
        means.select(*keys, F.explode(rows).alias("_row"))
        .select(*keys, "_row.*")
        .withColumn("gap", F.abs(F.col("mean_win") - F.col("mean_loss")))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("gap").desc_nulls_last(), "place")
    return (
        gaps.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select(*keys, "rank", "feature", "mean_win", "mean_loss", "gap")
    )


def box_stats(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers and outlier count of the largest percentage, per result.

    Percentages carry two digits, so counting equal values first leaves at most 10,001 rows per
    group whatever the number of trades; the quartiles are exact and weigh by these counts.
    """
    keys = [*keys, "result"]
    value = F.greatest("proba_hausse", "proba_neutre", "proba_baisse")
    counts = (
        trades.withColumn("value", value)
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    quartiles = counts.groupBy(*keys).agg(
        F.sum("n").alias("trades"),
        F.expr("percentile(value, array(0.25D, 0.5D, 0.75D), n)").alias("_q"),
    )
    quartiles = quartiles.select(
        *keys,
        "trades",
        *[F.col("_q")[n].alias(c) for n, c in enumerate(("q1", "median", "q3"))],
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return (
        counts.join(quartiles, keys)
        .withColumn("_inside", inside)
        .groupBy(*keys, "trades", "q1", "median", "q3")
        .agg(
            F.min(F.when(F.col("_inside"), F.col("value"))).alias("whisker_low"),
            F.max(F.when(F.col("_inside"), F.col("value"))).alias("whisker_high"),
            F.sum(F.when(F.col("_inside"), F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
        )
    )
