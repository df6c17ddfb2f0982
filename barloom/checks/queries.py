"""One query per operator, on bars derived from the ``events`` and ``orders`` tables.

Products that several steps read are stored in the shared folder, as a pipeline would.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import DROPPED_FEATURES, ML_COLUMNS, Account, Barriers, Forest, Split
from barloom.functions.clock import shift_hours
from barloom.functions.trading import (
    CANDIDATES,
    max_confidence,
    weight_default,
)
from barloom.operators import audit, cleaning, events, filters, losses, metrics, scores, sizing
from barloom.operators.asof import RightSide, asof_backward, asof_by_time
from barloom.operators.first_seen import clean_delivery
from barloom.operators.indicators import (
    add_indicators,
    base_features,
    hour_cyclic,
    log_returns,
    macro_returns,
)
from barloom.operators.increments import add_to_indicators
from barloom.operators.labels import (
    drop_unlabelled_tail,
    label_distribution,
    triple_barrier_label,
)
from barloom.operators.sliced import asof_sliced, write_sliced
from barloom.plans import models, training
from barloom.plans.evaluation import Rules, evaluation, evaluation_inputs, priced_trades
from barloom.plans.ml_table import (
    Series,
    drop_incomplete,
    labelled_features,
    macro_sides,
    merged_features,
    ml_table,
)
from barloom.session import shared_folder, stored
from barloom.sources import bar_files
from barloom.sources.report import performance_report
from barloom.sources.ticks import bars_from_events, bars_from_orders

EVENT_BARRIERS = Barriers(40_000.0, 20_000.0, 24, 1.0)
ORDER_BARRIERS = Barriers(800_000.0, 400_000.0, 24, 1.0)
EVENT_SERIES = Series("H1", "H4", "H8", (("purchase", "XAU_Return"), ("click", "CHF_Return")))
ORDER_SERIES = Series("D1", "D7", "D14", (("2-HIGH", "XAU_Return"), ("5-LOW", "CHF_Return")))
# Windows of a year of daily bars, in which nearer barriers would all be touched at once.
LONG_BARRIERS = Barriers(4_000_000.0, 3_000_000.0, 250, 1.0)
ACCOUNT = Account(capital=400_000_000.0)
RULES = Rules(ORDER_BARRIERS, ACCOUNT)
SPLIT = Split(train_end=1999, validate=2000, test=2001)
FOREST = Forest()
FEATURES = tuple(c for c in ML_COLUMNS if c not in ("Target", "Spread"))
MODEL_COLUMNS = ("Log_Return", "Dist_EMA_50", "RSI_14", "ADX_14", "ATR_Norm", "BB_Width")
INCREMENT_COLUMNS = ("Log_Return", "Dist_EMA_9", "Dist_EMA_50", "RSI_14", "ADX_14", "ATR_Norm", "BB_Width")
TIME_KEYS = ("symbol", "time")

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Round all doubles, ``other`` naming columns with a precision of their own."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, other.get(c, digits)) for c in doubles})


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(spark, sf_dir, ("H1",))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_orders(spark, sf_dir, ("D1",))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(bars_from_events(spark, sf_dir), ["timeframe"])


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(bars_from_orders(spark, sf_dir), ["timeframe"])


def rule_predictions(bars: DataFrame) -> DataFrame:
    """Predictions by a fixed rule on the position, in place of a model."""
    up = F.expr("(pos * 7919 + 17) % 101 + 1")
    flat = F.expr("(pos * 6007 + 5) % 103 + 1")
    down = F.expr("(pos * 4099 + 11) % 107 + 1")
    total = F.col("u") + F.col("n") + F.col("d")
    yhat = (
        F.when((F.col("d") >= F.col("n")) & (F.col("d") >= F.col("u")), -1)
        .when(F.col("n") >= F.col("u"), 0)
        .otherwise(1)
    )
    ruled = bars.withColumns({"u": up, "n": flat, "d": down})
    return ruled.select(
        *TIME_KEYS,
        F.col("Target").alias("y"),
        yhat.alias("yhat"),
        F.round(F.col("d") * 100.0 / total, 2).alias("conf_down"),
        F.round(F.col("n") * 100.0 / total, 2).alias("conf_flat"),
        F.round(F.col("u") * 100.0 / total, 2).alias("conf_up"),
        "spread",
        (F.col("d") / total).alias("p_down"),
        (F.col("n") / total).alias("p_flat"),
        (F.col("u") / total).alias("p_up"),
    )


def ruled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the rule, with class probabilities, for every daily bar."""
    bars = daily(spark, sf_dir)
    return rule_predictions(triple_barrier_label(bars, ORDER_BARRIERS, positions="given"))


def predictions(ruled: DataFrame) -> DataFrame:
    return ruled.drop("p_down", "p_flat", "p_up")


def with_strays(ruled: DataFrame) -> DataFrame:
    """Predictions, some of them also for a time half a day later, at which there is no bar."""
    late = ruled.where(F.expr("day(time) % 10 = 7")).withColumn("time", shift_hours(F.col("time"), 12.0))
    return ruled.unionByName(late)


def evaluation_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, daily bars and the feature table, as three products that know nothing of each
    other but symbol and time."""
    bars = order_bars(spark, sf_dir)
    table = stored(ml_table(bars, ORDER_SERIES, ORDER_BARRIERS, positions="given"))
    base = bars.where(F.col("timeframe") == ORDER_SERIES.base)
    ruled = rule_predictions(triple_barrier_label(base, ORDER_BARRIERS, positions="given"))
    return with_strays(predictions(ruled)), base, table


def inputs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation inputs for a query that reads them once."""
    return evaluation_inputs(*evaluation_tables(spark, sf_dir))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(inputs_once(spark, sf_dir))


def priced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = inputs(spark, sf_dir)
    return rows, priced_trades(rows, RULES)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.trades_table(priced(spark, sf_dir)[1])


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows as in a raw file, one per order, with some damaged fields.

    Orders of one priority and day share a time, so repeated times are the rule here.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("bigint").cast("string")
    day = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), cleaning.TIME_FORMAT)
    return orders.select(
        F.regexp_extract("o_orderpriority", "([A-Z]+)", 1).alias("symbol"),
        F.lit("D1").alias("timeframe"),
        F.when(key % 89 == 0, F.lit("not a time")).otherwise(day).alias("time"),
        price.alias("open"),
        F.when(key % 97 == 0, F.lit("")).otherwise(price).alias("high"),
        F.when(key % 83 == 0, F.lit("n/a")).otherwise(price).alias("low"),
        F.when(key % 79 == 0, F.lit("text")).otherwise(price).alias("close"),
        F.lit("1").alias("volume"),
        (F.col("o_custkey") % 30).cast("string").alias("spread"),
        key.alias("line"),
    )


def q_raw_files(spark, sf_dir):
    """Write the raw rows as text files, one folder per series, and clean what the reader finds.

    Rows are range-partitioned by line, so that file order is line order.
    """
    raw, files = written_files(spark, sf_dir)
    return cleaning.clean_bars(bar_files.only_readable(raw, files), bar_files.FILE_ORDER)


def written_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = shared_folder(spark)
    text = F.concat_ws("\t", *bar_files.RAW_COLUMNS, F.col("line").cast("string"))
    series = F.concat("symbol", F.lit("_"), "timeframe", F.lit(".csv"))
    lines = raw_rows(spark, sf_dir).select(series.alias("series"), "line", text.alias("value"))
    lines = lines.repartitionByRange("series", "line").sortWithinPartitions("series", "line")
    lines.drop("line").write.partitionBy("series").text(path)
    return bar_files.read_raw_bars(spark, path, "*.txt"), bar_files.checked_files(spark, path, "*.txt")


def q_rejected_files(spark, sf_dir):
    """Per file what the reader rejects, summed per series, because a series is many files."""
    raw, files = written_files(spark, sf_dir)
    report = bar_files.rejected_rows(raw, files)
    symbol = bar_files.symbol_of(F.col("file")).alias("symbol")
    return report.groupBy(symbol).agg(
        F.sum("rows").alias("rows"),
        F.sum("rejected").alias("rejected"),
        F.bool_or("unreadable").alias("unreadable"),
    )


def q_bars_round_trip(spark, sf_dir):
    path = shared_folder(spark)
    bar_files.write_table(daily(spark, sf_dir).drop("pos"), path, ["symbol", "timeframe"], ["time"])
    return bar_files.read_bars(spark, path)


def q_rewritten_year(spark, sf_dir):
    """A product by year of which one year is written anew with other volumes, without its last symbol."""
    path, bars = shared_folder(spark), filters.year_slice(daily(spark, sf_dir).drop("pos"), range(1990, 2003))
    bar_files.write_table(bars, path, ["year"], ["symbol", "time"])
    later = bars.where((F.col("year") == 2000) & (F.col("symbol") != "5-LOW"))
    later = later.withColumn("volume", F.col("volume") + 1000)
    bar_files.write_table(later, path, ["year"], ["symbol", "time"], replace="parts")
    written = spark.read.schema(bars.schema).parquet(path)
    return rounded(
        written.groupBy("year").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"), F.count_distinct("symbol").alias("symbols")
        )
    )


def q_missing_year(spark, sf_dir):
    """Bars per year of two yearly products, of which one does not exist."""
    path, bars = shared_folder(spark), daily(spark, sf_dir).drop("pos")
    bar_files.write_table(filters.year_slice(bars, [2000]).drop("year"), f"{path}/2000")
    years = [
        bar_files.optional_source(spark, f"{path}/{year}", bar_files.BAR_SCHEMA).withColumn("year", F.lit(year))
        for year in (2000, 2035)
    ]
    return years[0].unionByName(years[1]).groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


def q_feat_ema_since(spark, sf_dir):
    """Means over stored bars of the later years only, which are numbered anew."""
    late = order_bars(spark, sf_dir).where((F.col("timeframe") == "D1") & (F.col("time") >= filters.year_start(1998)))
    return rounded(add_indicators(late, ("EMA_20", "EMA_50")).select(*TIME_KEYS, "EMA_20", "EMA_50"), 2)


def q_clean_bars(spark, sf_dir):
    return cleaning.clean_bars(raw_rows(spark, sf_dir), ["line"], fmt=cleaning.TIME_FORMAT)


def q_clean_deliveries(spark, sf_dir):
    """The raw rows in three deliveries of growing size, each cleaned against the index of the ones before."""
    raw, index = stored(raw_rows(spark, sf_dir)), shared_folder(spark)
    last = raw.agg(F.max("line").alias("line")).first().line or 0
    bounds, parts = [-1, last // 9, last // 3, last], []
    for n, (above, to) in enumerate(zip(bounds, bounds[1:])):
        rows = raw.where((F.col("line") > above) & (F.col("line") <= to))
        parts.append(clean_delivery(rows, index, f"part{n}", ["line"], fmt=cleaning.TIME_FORMAT))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_clean_summary(spark, sf_dir):
    return cleaning.clean_summary(q_clean_bars(spark, sf_dir)).select(
        "symbol",
        "timeframe",
        "rows",
        F.col("first_day").cast("string").alias("first_day"),
        F.col("last_day").cast("string").alias("last_day"),
    )


def q_rejected_rows(spark, sf_dir):
    return bar_files.rejected_rows(
        raw_rows(spark, sf_dir), fmt=cleaning.TIME_FORMAT, name="symbol", order=["line"]
    )


def q_label_triple_barrier(spark, sf_dir):
    labelled = triple_barrier_label(hourly(spark, sf_dir), EVENT_BARRIERS, positions="given")
    return labelled.select(*TIME_KEYS, "close", F.col("Target").alias("target"))


def q_label_long_window(spark, sf_dir):
    labelled = triple_barrier_label(daily(spark, sf_dir), LONG_BARRIERS, positions="given")
    return labelled.select(*TIME_KEYS, "close", F.col("Target").alias("target"))


def q_unlabelled_tail(spark, sf_dir):
    labelled = triple_barrier_label(daily(spark, sf_dir), ORDER_BARRIERS, positions="given")
    return drop_unlabelled_tail(labelled).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.max("time").alias("last_time")
    )


def q_label_distribution(spark, sf_dir):
    labelled = triple_barrier_label(daily(spark, sf_dir), ORDER_BARRIERS, positions="given")
    return label_distribution(labelled).withColumnRenamed("Target", "target")


def entry_query(spark, sf_dir):
    labelled = triple_barrier_label(hourly(spark, sf_dir), EVENT_BARRIERS, positions="given")
    return label_distribution(drop_unlabelled_tail(labelled)).withColumnRenamed("Target", "target")


def feature_query(source: Callable, columns: tuple[str, ...], digits: int) -> Query:
    def query(spark, sf_dir):
        return rounded(
            add_indicators(source(spark, sf_dir), columns, positions="given").select(*TIME_KEYS, *columns), digits
        )

    return query


def q_log_return(spark, sf_dir):
    return rounded(log_returns(hourly(spark, sf_dir), positions="given").select(*TIME_KEYS, "Log_Return"), 9)


def q_hour_cyclic(spark, sf_dir):
    return rounded(hour_cyclic(hourly(spark, sf_dir)).select(*TIME_KEYS, "Hour_Sin", "Hour_Cos"))


def q_feat_increments(spark, sf_dir):
    """Features of bars that come in three parts, each computed from the part and the state before."""
    bars = stored(daily(spark, sf_dir).drop("pos"))
    cuts, state, found = (1900, 1995, 1998, 2100), None, None
    for first, end in zip(cuts, cuts[1:]):
        part = bars.where((F.col("time") >= filters.year_start(first)) & (F.col("time") < filters.year_start(end)))
        added, state = add_to_indicators(part, INCREMENT_COLUMNS, state)
        state = stored(state)
        found = added if found is None else found.unionByName(added)
    return rounded(found.select(*TIME_KEYS, *INCREMENT_COLUMNS))


def q_base_tf(spark, sf_dir):
    bars = bars_from_events(spark, sf_dir, ("H4", "H8"))
    return rounded(base_features(bars, "_C", positions="given"), 9, RSI_14_C=6)


def q_macro_returns(spark, sf_dir):
    names = dict(EVENT_SERIES.macro)
    return rounded(macro_returns(hourly(spark, sf_dir), names, positions="given").drop("timeframe"), 9)


def coarse_sides(bars: DataFrame, lag: float = 0.0) -> list[RightSide]:
    sides = []
    for timeframe, suffix in (("H4", "_H4"), ("H8", "_D1")):
        feats = base_features(bars.where(F.col("timeframe") == timeframe), suffix, positions="given")
        names = (f"RSI_14{suffix}", f"Dist_EMA_20{suffix}", f"Dist_EMA_50{suffix}")
        sides.append(RightSide(feats.drop("timeframe"), names, lag))
    return sides


def with_coarse(spark, sf_dir, lag: float) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    left = bars.where(F.col("timeframe") == "H1").select(*TIME_KEYS, "close")
    joined = asof_backward(left, coarse_sides(bars, lag), ["symbol"])
    return rounded(joined, 9, RSI_14_H4=6, RSI_14_D1=6)


def q_asof_multi_timeframe(spark, sf_dir):
    return with_coarse(spark, sf_dir, 0.0)


def q_asof_when_known(spark, sf_dir):
    """The same join, each coarse bar delayed by 8 hours."""
    return with_coarse(spark, sf_dir, 8.0)


def q_asof_sliced(spark, sf_dir):
    """Bars and coarse features as bucketed tables of the catalog, joined bucket by bucket."""
    bars, run, buckets = event_bars(spark, sf_dir), uuid.uuid4().hex, 8
    fine = bars.where(F.col("timeframe") == "H1").select(*TIME_KEYS, "close")
    left = write_sliced(fine, f"bars_{run}", buckets)
    rights = [
        (write_sliced(side.df, f"side{n}_{run}", buckets), side.payload)
        for n, side in enumerate(coarse_sides(bars))
    ]
    return rounded(asof_sliced(left, rights), 9, RSI_14_H4=6, RSI_14_D1=6)


def q_asof_macro(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    left = bars.where(F.col("timeframe") == "H1").select(*TIME_KEYS, "close")
    return rounded(asof_by_time(left, macro_sides(bars, EVENT_SERIES, positions="given")), 9)


def full_table(spark, sf_dir) -> DataFrame:
    return ml_table(order_bars(spark, sf_dir), ORDER_SERIES, ORDER_BARRIERS, positions="given")


ML_DIGITS = {c: 6 for c in ("RSI_14", "ADX_14", "RSI_14_H4", "RSI_14_D1")}


def q_ml_table(spark, sf_dir):
    return rounded(full_table(spark, sf_dir), 9, **ML_DIGITS)


def q_model_features(spark, sf_dir):
    table = stored(labelled_features(order_bars(spark, sf_dir), ORDER_SERIES, ORDER_BARRIERS, positions="given"))
    table = drop_incomplete(table)
    names = filters.feature_columns(
        table, ("Target", "pos", "open", "high", "low", "close", "volume", "spread"), DROPPED_FEATURES
    )
    return rounded(table.select(*TIME_KEYS, *names), 9, RSI_14=6, ADX_14=6)


def q_row_loss_audit(spark, sf_dir):
    ruled, base, table = evaluation_tables(spark, sf_dir)
    labelled = drop_unlabelled_tail(triple_barrier_label(base, ORDER_BARRIERS, positions="given"))
    joined = events.join_prices(ruled, base)
    chains = [
        [("bars", base), ("label", labelled), ("features", table)],
        [
            ("predictions", ruled),
            ("join prices", joined),
            ("join features", events.join_features(joined, table)),
        ],
    ]
    return rounded(audit.row_loss_audit(chains))


def q_merge_null_audit(spark, sf_dir):
    merged = merged_features(order_bars(spark, sf_dir), ORDER_SERIES, ORDER_BARRIERS, positions="given")
    probes = {"middle": "RSI_14_H4", "coarse": "RSI_14_D1", "xau": "XAU_Return", "chf": "CHF_Return"}
    return rounded(audit.merge_null_audit(merged, probes))


def q_purged_split(spark, sf_dir):
    return filters.purged_train_split(daily(spark, sf_dir), SPLIT).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.max("time").alias("last_time")
    )


def q_purged_split_bars(spark, sf_dir):
    split = Split(SPLIT.train_end, SPLIT.validate, SPLIT.test, purge_bars=24)
    return filters.purged_train_split(daily(spark, sf_dir), split).select(*TIME_KEYS, "close")


def q_year_slice(spark, sf_dir):
    return filters.year_slice(daily(spark, sf_dir), SPLIT.evaluation_years).select(
        *TIME_KEYS, "year", "close"
    )


def q_signals(spark, sf_dir):
    return inputs_once(spark, sf_dir).select(
        *TIME_KEYS, "year", "yhat", "signal", F.round("proba_max", 6).alias("proba_max")
    )


def q_weights(spark, sf_dir):
    rows = inputs_once(spark, sf_dir).select(*TIME_KEYS, "signal", "proba_max")
    tried = events.with_weights(rows, weight_default).withColumnRenamed("weight", "weight_default")
    for n, weight in enumerate(CANDIDATES.values()):
        tried = events.with_weights(tried, weight).withColumnRenamed("weight", f"weight_{n}")
    return rounded(tried)


def q_max_confidence(spark, sf_dir):
    rows = predictions(ruled_bars(spark, sf_dir))
    return rounded(rows.select(*TIME_KEYS, max_confidence().alias("proba_max")))


def q_signal_count(spark, sf_dir):
    return events.signal_count(inputs_once(spark, sf_dir))


def q_first_passage(spark, sf_dir):
    return events.first_passage(inputs(spark, sf_dir), ORDER_BARRIERS).select(
        "symbol", "year", "time", "signal", "pos", "free_at", "result"
    )


def q_first_passage_long(spark, sf_dir):
    return events.first_passage(inputs(spark, sf_dir), LONG_BARRIERS).select(
        "symbol", "year", "time", "signal", "pos", "free_at", "result"
    )


def q_non_overlapping_events(spark, sf_dir):
    found = events.first_passage(inputs(spark, sf_dir), ORDER_BARRIERS)
    return events.non_overlapping_events(found, ORDER_BARRIERS.window).select(
        "symbol", "year", "time", "pos", "free_at", "result"
    )


def q_trades(spark, sf_dir):
    return rounded(trades(spark, sf_dir))


def q_entries(spark, sf_dir):
    rows, found = priced(spark, sf_dir)
    return events.semi_join_entries(rows, found).select(*TIME_KEYS, "close", "signal")


def enriched(spark, sf_dir) -> DataFrame:
    rows, found = priced(spark, sf_dir)
    return events.enrich_trades(events.trades_table(found), rows)


def q_trades_enriched(spark, sf_dir):
    return rounded(enriched(spark, sf_dir), 9, **ML_DIGITS, net=6, gross=6, weight=6)


def q_win_rate_profit(spark, sf_dir):
    return rounded(metrics.win_rate_profit(trades(spark, sf_dir)))


def q_equity_drawdown(spark, sf_dir):
    return rounded(
        metrics.equity_curve(trades(spark, sf_dir)).select(
            "symbol", "year", "time", "equity", "peak", "drawdown"
        ),
        4,
    )


def q_max_drawdown(spark, sf_dir):
    return rounded(metrics.max_drawdown(trades(spark, sf_dir)), 4)


def q_daily_pnl(spark, sf_dir):
    return rounded(metrics.daily_pnl(trades(spark, sf_dir)), 4)


def q_sharpe(spark, sf_dir):
    return rounded(metrics.sharpe(trades(spark, sf_dir)))


def q_buy_and_hold(spark, sf_dir):
    return rounded(metrics.buy_and_hold(inputs_once(spark, sf_dir), ORDER_BARRIERS))


def record(spark, sf_dir) -> DataFrame:
    return evaluation(inputs(spark, sf_dir), RULES)


def q_metrics(spark, sf_dir):
    return rounded(record(spark, sf_dir), 4)


def q_yearly_summary(spark, sf_dir):
    return rounded(metrics.yearly_summary(record(spark, sf_dir)), 4)


def q_performance_report(spark, sf_dir):
    return performance_report(record(spark, sf_dir), ORDER_BARRIERS, ACCOUNT)


def q_win_loss_filter(spark, sf_dir):
    found = stored(trades(spark, sf_dir))
    sides = [
        filters.winners(found).withColumn("side", F.lit("winner")),
        filters.losers(found).withColumn("side", F.lit("loser")),
    ]
    return rounded(sides[0].unionByName(sides[1]).select(*TIME_KEYS, "side", "net"))


def q_loss_breakdown(spark, sf_dir):
    return rounded(losses.loss_breakdown(trades(spark, sf_dir)))


def q_mean_gap_top5(spark, sf_dir):
    return rounded(losses.mean_gap_top(enriched(spark, sf_dir), FEATURES), 8)


def q_box_stats(spark, sf_dir):
    return rounded(losses.box_stats(enriched(spark, sf_dir)), 4)


def sweep(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Inputs, and the sweep on the validation year; trades are found for that year alone."""
    rows = inputs(spark, sf_dir)
    val_rows = filters.year_slice(rows, [SPLIT.validate])
    val_trades = priced_trades(val_rows, RULES)
    return rows, sizing.sizing_sweep(val_trades, val_rows, ORDER_BARRIERS, ACCOUNT)


def q_sizing_sweep(spark, sf_dir):
    return rounded(sweep(spark, sf_dir)[1], 4)


def q_best_candidate(spark, sf_dir):
    return rounded(sizing.best_candidate(sweep(spark, sf_dir)[1]), 4)


def q_confirm_on_test(spark, sf_dir):
    rows, tried = sweep(spark, sf_dir)
    test_rows = filters.year_slice(rows, [SPLIT.test])
    confirmed = sizing.confirm_on_test(
        sizing.best_candidate(tried),
        priced_trades(test_rows, RULES),
        test_rows,
        ORDER_BARRIERS,
        ACCOUNT,
    )
    return rounded(confirmed, 4)


def q_class_weights(spark, sf_dir):
    labelled = triple_barrier_label(daily(spark, sf_dir), ORDER_BARRIERS, positions="given")
    train = filters.purged_train_split(drop_unlabelled_tail(labelled), SPLIT)
    return rounded(scores.balanced_weights(train).withColumnRenamed("Target", "target"))


def q_prediction_table(spark, sf_dir):
    return scores.prediction_table(ruled_bars(spark, sf_dir))


def scored(spark, sf_dir) -> DataFrame:
    ruled = predictions(ruled_bars(spark, sf_dir)).where(F.col("y").isNotNull())
    return filters.year_slice(ruled, SPLIT.evaluation_years)


def q_accuracy(spark, sf_dir):
    return rounded(scores.accuracy(scored(spark, sf_dir)))


def q_classification_report(spark, sf_dir):
    return rounded(scores.classification_report(scored(spark, sf_dir)))


def rule_scorer(rows: DataFrame) -> DataFrame:
    """A fixed rule in place of a model: the side of the middle on which the RSI lies."""
    rsi = F.col("values")[0]
    return rows.withColumn("prediction", F.when(rsi > 55, 2.0).when(rsi < 45, 0.0).otherwise(1.0))


RULE_FEATURES = ("RSI_14", "ATR_Norm")


def q_permutation_by_rule(spark, sf_dir):
    """Permutation importance of a rule that reads one of two features."""
    table = stored(full_table(spark, sf_dir))
    return training.permutation_importance(rule_scorer, table, RULE_FEATURES, SPLIT.validate, FOREST)


def q_importance_filter(spark, sf_dir):
    return filters.importance_filter(q_permutation_by_rule(spark, sf_dir))


def fitted(spark, sf_dir):
    table = stored(full_table(spark, sf_dir))
    names = filters.feature_columns(table)
    return table, names, models.stored_forest(table, names, SPLIT, FOREST)


def q_forest_predictions(spark, sf_dir):
    table, _, model = fitted(spark, sf_dir)
    return scores.prediction_table(
        training.predict_proba(model, table, SPLIT.evaluation_years)
    )


def q_forest_checks(spark, sf_dir):
    """Per year: rows scored, probabilities that do not add up, and classes that are not the most
    probable one."""
    table, _, model = fitted(spark, sf_dir)
    p = [F.col(c) for c in ("p_down", "p_flat", "p_up")]
    scored = training.predict_proba(model, table, SPLIT.evaluation_years)
    most = F.greatest(*p)
    chosen = F.when(F.col("yhat") == -1, p[0]).when(F.col("yhat") == 0, p[1]).otherwise(p[2])
    return scored.groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(p[0] + p[1] + p[2] - 1) > 1e-9).alias("wrong_sum"),
        F.count_if(chosen < most).alias("not_most"),
    )


def q_impurity_importance(spark, sf_dir):
    _, names, model = fitted(spark, sf_dir)
    return training.impurity_importance(model, names)


def q_impurity_checks(spark, sf_dir):
    shares = q_impurity_importance(spark, sf_dir)
    return shares.agg(
        F.count(F.lit(1)).alias("features"),
        F.round(F.sum("impurity_pct")).alias("total_pct"),
        F.count_if(F.col("impurity_pct") < 0).alias("negative"),
        F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("names"),
    )


def q_permutation_importance(spark, sf_dir):
    table, names, model = fitted(spark, sf_dir)
    score = training.forest_scorer(model)
    return training.permutation_importance(score, table, names, SPLIT.validate, FOREST)


def q_importance_table(spark, sf_dir):
    """Both importances of the fitted forest in one table."""
    table, names, model = fitted(spark, sf_dir)
    score = training.forest_scorer(model)
    moved = training.permutation_importance(score, table, names, SPLIT.validate, FOREST)
    return training.importance_table(training.impurity_importance(model, names), moved)


QUERIES: dict[str, Query] = {
    "clean_bars": q_clean_bars,
    "clean_deliveries": q_clean_deliveries,
    "raw_files": q_raw_files,
    "rejected_files": q_rejected_files,
    "bars_round_trip": q_bars_round_trip,
    "rewritten_year": q_rewritten_year,
    "missing_year": q_missing_year,
    "feat_ema_since": q_feat_ema_since,
    "clean_summary": q_clean_summary,
    "rejected_rows": q_rejected_rows,
    "label_triple_barrier": q_label_triple_barrier,
    "label_long_window": q_label_long_window,
    "unlabelled_tail": q_unlabelled_tail,
    "label_distribution": q_label_distribution,
    "feat_log_return": q_log_return,
    "feat_ema": feature_query(hourly, ("EMA_9", "EMA_20", "EMA_21", "EMA_50"), 2),
    "feat_dist_ema": feature_query(hourly, ("Dist_EMA_9", "Dist_EMA_21", "Dist_EMA_50"), 9),
    "feat_rsi": feature_query(daily, ("RSI_14",), 6),
    "feat_atr_norm": feature_query(hourly, ("ATR_Norm",), 9),
    "feat_adx": feature_query(daily, ("ADX_14",), 6),
    "feat_bb_width": feature_query(hourly, ("BB_Width",), 8),
    "feat_hour_cyclic": q_hour_cyclic,
    "feat_increments": q_feat_increments,
    "feat_base_tf": q_base_tf,
    "feat_macro_returns": q_macro_returns,
    "asof_multi_timeframe": q_asof_multi_timeframe,
    "asof_when_known": q_asof_when_known,
    "asof_sliced": q_asof_sliced,
    "asof_macro": q_asof_macro,
    "ml_table": q_ml_table,
    "model_features": q_model_features,
    "row_loss_audit": q_row_loss_audit,
    "merge_null_audit": q_merge_null_audit,
    "purged_split": q_purged_split,
    "purged_split_bars": q_purged_split_bars,
    "year_slice": q_year_slice,
    "max_confidence": q_max_confidence,
    "signals": q_signals,
    "weights": q_weights,
    "signal_count": q_signal_count,
    "first_passage": q_first_passage,
    "first_passage_long": q_first_passage_long,
    "non_overlapping_events": q_non_overlapping_events,
    "trades": q_trades,
    "entries": q_entries,
    "trades_enriched": q_trades_enriched,
    "win_rate_profit": q_win_rate_profit,
    "equity_drawdown": q_equity_drawdown,
    "max_drawdown": q_max_drawdown,
    "daily_pnl": q_daily_pnl,
    "sharpe": q_sharpe,
    "buy_and_hold": q_buy_and_hold,
    "metrics": q_metrics,
    "yearly_summary": q_yearly_summary,
    "performance_report": q_performance_report,
    "win_loss_filter": q_win_loss_filter,
    "loss_breakdown": q_loss_breakdown,
    "mean_gap_top5": q_mean_gap_top5,
    "box_stats": q_box_stats,
    "sizing_sweep": q_sizing_sweep,
    "best_candidate": q_best_candidate,
    "confirm_on_test": q_confirm_on_test,
    "class_weights": q_class_weights,
    "prediction_table": q_prediction_table,
    "accuracy": q_accuracy,
    "classification_report": q_classification_report,
    "importance_filter": q_importance_filter,
    "permutation_by_rule": q_permutation_by_rule,
    "forest_checks": q_forest_checks,
    "impurity_checks": q_impurity_checks,
    "importance_table": q_importance_table,
    "forest_predictions": q_forest_predictions,
    "impurity_importance": q_impurity_importance,
    "permutation_importance": q_permutation_importance,
}
