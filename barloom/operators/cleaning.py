"""From raw text rows to clean bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_COLUMNS = ("open", "high", "low", "close", "volume", "spread")

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# The formats a file may be written in, in the order in which they are tried.
TIME_FORMATS = (
    TIME_FORMAT,
    "yyyy.MM.dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy.MM.dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy.MM.dd",
)

DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_time(text: Column, fmt: str = TIME_FORMAT) -> Column:
    """Zone-free time, NULL where the text does not fit the one format of the file."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parse_number(text: Column) -> Column:
    """Decimal number, NULL for everything else: missing marks, text, infinities and numbers with a
    type letter, which a plain cast would take."""
    trimmed = F.trim(text)
    value = F.when(trimmed.rlike(DECIMAL), trimmed.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def first_format(text: Column, formats: Sequence[str]) -> Column:
    """Number of the first format that the text fits, NULL if none."""
    fits = [F.when(parse_time(text, fmt).isNotNull(), F.lit(n)) for n, fmt in enumerate(formats)]
    return F.coalesce(*fits)


def file_formats(
    raw: DataFrame, order: Sequence[str], by: Sequence[str], formats: Sequence[str] = TIME_FORMATS
) -> DataFrame:
    """Per file (``by``): the format of its first readable time. A file without one has no row."""
    seen = raw.withColumn("time_format", first_format(F.col("time"), formats)).dropna(
        subset=["time_format"]
    )
    first = F.min_by("time_format", F.struct(*order))
    return seen.groupBy(*by).agg(first.alias("time_format"))


def typed(
    raw: DataFrame,
    fmt: str | Sequence[str] = TIME_FORMAT,
    order: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Replace the text columns by typed ones and keep everything else.

    One format holds for all rows; of several, each file (``by``) takes that of its first readable
    time in ``order``, and rows in another format have no time.
    """
    if isinstance(fmt, str):
        df = raw.withColumn("time", parse_time(F.col("time"), fmt))
    else:
        known = raw.join(file_formats(raw, order, by, fmt), list(by), "left")
        cases = [
            F.when(F.col("time_format") == n, parse_time(F.col("time"), one))
            for n, one in enumerate(fmt)
        ]
        df = known.withColumn("time", F.coalesce(*cases)).drop("time_format")
    return df.withColumns({c: parse_number(F.col(c)) for c in PRICE_COLUMNS})


def drop_bad_time(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["time"])


def dedup_keep_first(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("symbol", "timeframe")
) -> DataFrame:
    """Keep the first row per time in file order.

    A minimum is combined before the shuffle, so any number of copies of one time ends as one row
    per input partition. One number to order by leaves a plain hash aggregation.
    """
    rest = [c for c in df.columns if c not in (*keys, "time", *order)]
    if len(order) == 1:
        firsts = [F.min_by(c, order[0]).alias(c) for c in rest]
        return df.groupBy(*keys, "time").agg(*firsts).select(*keys, "time", *rest)
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys, "time").agg(first.alias("_row")).select(*keys, "time", "_row.*")


def clean_bars(
    raw: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = ("symbol", "timeframe"),
    fmt: str | Sequence[str] = TIME_FORMATS,
) -> DataFrame:
    """Parse, drop rows without a time, keep the first row per time, then drop incomplete rows.

    The order matters: a time whose first copy is incomplete is lost as a whole. With several
    formats each file takes one; rows that name no file are a file per series.
    """
    by = ["file"] if "file" in raw.columns else list(keys)
    timed = drop_bad_time(typed(raw, fmt, order, by))
    wanted = timed.select(*keys, "time", *PRICE_COLUMNS, *order)
    return dedup_keep_first(wanted, order, keys).dropna().select(*keys, "time", *PRICE_COLUMNS)


def clean_summary(bars: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Rows kept, first and last day per series."""
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("time").cast("date").alias("first_day"),
        F.max("time").cast("date").alias("last_day"),
    )
