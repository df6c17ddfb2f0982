"""Cleaning one delivery of raw rows after another, without reading earlier deliveries again.

What cleaning must remember is which times of a series were seen, also those whose first copy was
incomplete: such a time is lost as a whole, however many complete copies come later. The index holds
these (series, time) keys and nothing else, in folders by time slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import Layout
from barloom.operators.cleaning import PRICE_COLUMNS, TIME_FORMATS, dedup_keep_first, drop_bad_time, typed
from barloom.operators.series import with_slice
from barloom.session import stored
from barloom.sources.bar_files import optional_source, write_table


def seen_keys(
    spark: SparkSession, index: str, keys: Sequence[str] = ("symbol", "timeframe")
) -> DataFrame:
    """The keys in the index at this path; none, if there is no index yet."""
    fields = [T.StructField(k, T.StringType()) for k in keys]
    fields += [T.StructField("time", T.TimestampNTZType()), T.StructField("_slice", T.LongType())]
    return optional_source(spark, index, T.StructType([*fields, T.StructField("delivery", T.StringType())]))


def clean_delivery(
    raw: DataFrame,
    index: str,
    delivery: str,
    order: Sequence[str],
    keys: Sequence[str] = ("symbol", "timeframe"),
    fmt: str | Sequence[str] = TIME_FORMATS,
    layout: Layout = Layout(),
) -> DataFrame:
    """Clean bars of the series and times that no earlier delivery held; they join the index.

    Deliveries cleaned in turn give the bars of one ``clean_bars`` over all of them in that order.
    Keys must not be null. The keys of a delivery are written before its bars are returned, under its
    name: to repeat a delivery whose bars were lost, call this again with that name before the next
    one, and its keys replace those of the first try and hide nothing from itself.

    Only index folders between the first and the last slice of the delivery are read. Of their keys,
    those that the delivery holds are found first, and the delivery is then joined with these alone:
    at most as many as it has rows itself.
    """
    spark, place = raw.sparkSession, [*keys, "time"]
    by = ["file"] if "file" in raw.columns else list(keys)
    timed = drop_bad_time(typed(raw, fmt, order, by))
    wanted = timed.select(*place, *PRICE_COLUMNS, *order)
    first = stored(with_slice(dedup_keep_first(wanted, order, keys), layout), ["_slice"])
    span = first.agg(F.min("_slice").alias("low"), F.max("_slice").alias("high")).first()
    known = seen_keys(spark, index, keys).where(F.col("delivery") != delivery)
    known = known.where(F.col("_slice").between(F.lit(span.low), F.lit(span.high)))
    again = known.join(first.select(*place, "_slice"), [*place, "_slice"], "left_semi")
    fresh = stored(first.join(again, [*place, "_slice"], "left_anti"), ["_slice"])
    added = fresh.select(*place, "_slice", F.lit(delivery).alias("delivery"))
    write_table(added, index, ["_slice", "delivery"], ["time"], replace="parts")
    return fresh.select(*place, *PRICE_COLUMNS).dropna()
