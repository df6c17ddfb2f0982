"""As-of joins: each left row takes the last right row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Layout
from barloom.functions.clock import shift_hours
from barloom.operators.series import FIRST, NOW, with_slice


@dataclass(frozen=True)
class RightSide:
    """One right table: its payload columns, and how long after its time a row is known.

    Times must be unique per key, as after ``dedup_keep_first``. ``availability_lag`` in hours
    moves the right times back, so that a bar stamped with its opening time is matched only once
    it has closed; 0 matches it from its opening on.
    """

    df: DataFrame
    payload: tuple[str, ...]
    availability_lag: float = 0.0


def carried_rows(ends: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per key and slice the last rows (``names``) of all earlier slices, from one row per slice and
    side or several. Slices without a right row of their own are rows of NULLs."""
    ends = ends.groupBy(*keys, "_slice").agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in names]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(FIRST, -1)
    return ends.select(
        *keys, "_slice", *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in names]
    )


def last_so_far(merged: DataFrame, place: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The left rows (``_side`` 2) of a merged table, each with the last right rows so far of its
    slice, which the columns ``place`` tell.

    Carried rows (0) have no time and sort first; on equal times right rows (1) come before left ones.
    """
    order = Window.partitionBy(*place).orderBy(F.col("time").asc_nulls_first(), "_side")
    so_far = order.rowsBetween(FIRST, NOW)
    found = merged.withColumns({n: F.last(n, ignorenulls=True).over(so_far) for n in names})
    return found.where(F.col("_side") == 2)


def asof_backward(
    left: DataFrame,
    rights: Sequence[RightSide],
    keys: Sequence[str] = ("symbol",),
    layout: Layout = Layout(),
    times: DataFrame | None = None,
) -> DataFrame:
    """Left rows with the payload of every right table, NULL where nothing came before.

    ``times`` is any table whose keys and times include those of ``left`` and that is cheaper to
    read a second time; only its distinct slices are used.

    All rights are matched in one pass: rows are merged by time inside (keys, time slice), and the
    last right row of the earlier slices enters each slice as one extra row. A matched right row
    counts even if its values are NULL, which is why the payload travels as a struct.
    """
    keys = list(keys)
    names = [f"_right{n}" for n in range(len(rights))]
    sides = []
    for name, right in zip(names, rights):
        time = F.col("time")
        if right.availability_lag:
            time = shift_hours(time, right.availability_lag)
        payload = F.struct(*right.payload).alias(name)
        sides.append(with_slice(right.df.select(*keys, time.alias("time"), payload), layout))

    # The last row of each right table per slice, carried to the slices after it.
    span = (left if times is None else times).select(*keys, "time")
    ends = with_slice(span, layout).select(*keys, "_slice").distinct()
    for name, side in zip(names, sides):
        last = side.groupBy(*keys, "_slice").agg(F.max_by(name, "time").alias(name))
        ends = ends.unionByName(last, allowMissingColumns=True)
    carried = carried_rows(ends, keys, names)

    merged = with_slice(left, layout).withColumn("_side", F.lit(2))
    for side in sides:
        merged = merged.unionByName(side.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    merged = merged.unionByName(carried.withColumn("_side", F.lit(0)), allowMissingColumns=True)

    matched = last_so_far(merged.repartition(*keys, "_slice"), [*keys, "_slice"], names)
    picked = [
        F.col(f"{name}.{c}").alias(c) for name, right in zip(names, rights) for c in right.payload
    ]
    return matched.select(*left.columns, *picked)


def asof_by_time(
    left: DataFrame,
    rights: Sequence[RightSide],
    layout: Layout = Layout(),
    times: DataFrame | None = None,
) -> DataFrame:
    """As-of join by time alone, for rights that serve every key of the left table alike.

    The match depends on the time only, so it is computed once per distinct left time and joined
    back by equality; the left rows are never gathered per slice. The lookup has one row per
    distinct time, and Spark broadcasts it only if its measured size allows.
    """
    span = (left if times is None else times).select("time")
    moments = span.distinct().withColumn("_all", F.lit(1))
    keyed = [
        RightSide(r.df.withColumn("_all", F.lit(1)), r.payload, r.availability_lag) for r in rights
    ]
    lookup = asof_backward(
        moments, keyed, ["_all"], layout, span.withColumn("_all", F.lit(1))
    ).drop("_all")
    return left.join(lookup, "time", "left").select(
        *left.columns, *[c for r in rights for c in r.payload]
    )
