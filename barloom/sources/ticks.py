"""Bars from tick-like rows, and the two tick streams found in the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.clock import DAY, bucket, epoch_seconds, time_of

EVENT_TIMEFRAMES = {"H1": 3_600, "H4": 4 * 3_600, "H8": 8 * 3_600}
EVENT_SLICE = 600
ORDER_TIMEFRAMES = {"D1": DAY, "D7": 7 * DAY, "D14": 14 * DAY}


def bars_from_ticks(
    ticks: DataFrame,
    timeframes: dict[str, int],
    base: int,
    slice_seconds: int,
    part: Column | None = None,
) -> DataFrame:
    """Bars of every timeframe from ``ticks(symbol, time, seq, delta, spread)``, with ``pos``.

    The price is ``base`` plus the running sum of ``delta`` by (time, seq). A slice, or where
    ``part`` is given each part of it, is reduced to one row relative to its own start; parts are
    joined to slices, and the level at the start of a slice is the running total over slices, of
    which a symbol has one row each. So no task ever holds more than a part of a slice, the raw
    rows are shuffled once whatever the number of timeframes, and the position of every bar in its
    series falls out of the same order of slices. ``part`` must be monotone in (time, seq), and
    ``slice_seconds`` divide the timeframes.
    """
    keys = ["symbol", "_slice", "_part"]
    cut = ticks.withColumn("_slice", bucket("time", slice_seconds)).withColumn(
        "_part", F.lit(0).cast("bigint") if part is None else part.cast("bigint")
    )
    inside = Window.partitionBy(*keys).orderBy("time", "seq")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = (
        cut.withColumn("_level", F.sum("delta").over(so_far))
        .withColumn("_n", F.row_number().over(inside))
        .groupBy(*keys)
        .agg(
            F.min_by("_level", "_n").alias("open"),
            F.max("_level").alias("high"),
            F.min("_level").alias("low"),
            F.max_by("_level", "_n").alias("close"),
            F.count(F.lit(1)).alias("volume"),
            F.max_by("spread", "_n").alias("spread"),
        )
    )
    if part is not None:
        pieces = joined_parts(pieces)
    in_order = Window.partitionBy("symbol").orderBy("_slice")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(base) + F.coalesce(F.sum("close").over(before), F.lit(0))
    level = pieces.withColumn("_start", start)
    bars = {n: F.expr(f"(_slice * {slice_seconds}) div {w}") for n, w in timeframes.items()}
    level = level.withColumns({f"_bar_{n}": bar for n, bar in bars.items()})
    opens = {
        n: F.when(F.col(f"_bar_{n}").eqNullSafe(F.lag(f"_bar_{n}").over(in_order)), 0).otherwise(1)
        for n in bars
    }
    up_to_now = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = level.withColumns({f"_opens_{n}": o for n, o in opens.items()})
    level = level.withColumns({f"_pos_{n}": F.sum(f"_opens_{n}").over(up_to_now) - 1 for n in bars})
    frames = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("timeframe"),
                    F.lit(width).cast("bigint").alias("width"),
                    F.col(f"_bar_{name}").alias("_bar"),
                    F.col(f"_pos_{name}").alias("pos"),
                )
                for name, width in timeframes.items()
            ]
        )
    )
    return (
        level.select("*", frames)
        .groupBy("symbol", "timeframe", "width", "_bar")
        .agg(
            F.min_by(F.col("_start") + F.col("open"), "_slice").cast("double").alias("open"),
            F.max(F.col("_start") + F.col("high")).cast("double").alias("high"),
            F.min(F.col("_start") + F.col("low")).cast("double").alias("low"),
            F.max_by(F.col("_start") + F.col("close"), "_slice").cast("double").alias("close"),
            F.sum("volume").cast("double").alias("volume"),
            F.max_by("spread", "_slice").cast("double").alias("spread"),
            F.min("pos").alias("pos"),
        )
        .select(
            "symbol",
            "timeframe",
            time_of("(_bar * width)").alias("time"),
            "open",
            "high",
            "low",
            "close",
            "volume",
            "spread",
            "pos",
        )
    )


def joined_parts(pieces: DataFrame) -> DataFrame:
    """One row per slice from one row per part of it, still relative to the start of the slice."""
    before = Window.partitionBy("symbol", "_slice").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("close").over(before), F.lit(0))
    moved = pieces.withColumn("_start", start)
    return moved.groupBy("symbol", "_slice").agg(
        F.min_by(F.col("_start") + F.col("open"), "_part").alias("open"),
        F.max(F.col("_start") + F.col("high")).alias("high"),
        F.min(F.col("_start") + F.col("low")).alias("low"),
        F.max_by(F.col("_start") + F.col("close"), "_part").alias("close"),
        F.sum("volume").alias("volume"),
        F.max_by("spread", "_part").alias("spread"),
    )


def bars_from_events(
    spark: SparkSession, sf_dir: str, timeframes: tuple[str, ...] = tuple(EVENT_TIMEFRAMES)
) -> DataFrame:
    """Intraday bars per event type from the ``events`` table; a slice is cut by the second."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("time"),
        F.col("event_id").alias("seq"),
        (F.round(F.col("value") * 100) - 5000).cast("bigint").alias("delta"),
        F.get_json_object("props", "$.k").cast("int").alias("spread"),
    )
    wanted = {name: EVENT_TIMEFRAMES[name] for name in timeframes}
    second = F.expr(f"{epoch_seconds('time')} % {EVENT_SLICE}")
    return bars_from_ticks(ticks, wanted, 10_000_000, EVENT_SLICE, part=second)


def bars_from_orders(
    spark: SparkSession, sf_dir: str, timeframes: tuple[str, ...] = tuple(ORDER_TIMEFRAMES)
) -> DataFrame:
    """Daily and coarser bars per order priority from the ``orders`` table.

    All orders of a day carry the same time, so a day can be cut further by ranges of the key.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ticks = orders.select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("time"),
        F.col("o_orderkey").alias("seq"),
        (F.round("o_totalprice") - 250_000).cast("bigint").alias("delta"),
        (F.col("o_custkey") % 30).cast("int").alias("spread"),
    )
    wanted = {name: ORDER_TIMEFRAMES[name] for name in timeframes}
    part = F.shiftright(F.col("seq"), 28)
    return bars_from_ticks(ticks, wanted, base=1_000_000_000, slice_seconds=DAY, part=part)
