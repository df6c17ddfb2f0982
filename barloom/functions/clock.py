"""Arithmetic on zone-free timestamps.

Casting a zone-free timestamp to a number goes through the session time zone, so these
expressions are built from the calendar fields instead and give the same result in every zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def epoch_seconds(time: str) -> str:
    """SQL text: whole seconds since 1970-01-01 00:00:00 on the same clock."""
    day = f"cast(unix_date(cast({time} as date)) as bigint) * {DAY}"
    return f"({day} + hour({time}) * 3600 + minute({time}) * 60 + second({time}))"


def bucket(time: str, seconds: int) -> Column:
    """Number of the ``seconds``-wide bucket that holds ``time``, counted from 1970."""
    return F.expr(f"floor({epoch_seconds(time)} / {seconds})")


def time_of(seconds: str) -> Column:
    """``timestamp_ntz`` that lies that many seconds after the start of 1970."""
    return F.expr(
        f"cast(date_from_unix_date(cast(floor({seconds} / {DAY}) as int)) as timestamp_ntz)"
        f" + make_dt_interval(0, 0, 0, pmod({seconds}, {DAY}L))"
    )


def year_start(year: int) -> Column:
    return F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")


def shift_hours(time: Column, hours: float) -> Column:
    return time + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600).cast("decimal(18,6)")
    )


def day_of(time: Column) -> Column:
    return time.cast("date").cast("timestamp_ntz")
