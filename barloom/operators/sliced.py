"""Bars stored for as-of joins, so that a join of stored tables shuffles no bar.

A table is bucketed in the catalog by (key, time slice), each bucket one file sorted by time. Beside
it lies a small table with the last row of every slice. Tables of one slice width and number of
buckets meet bucket by bucket; only the rows of the small tables travel, one per key and slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import Layout
from barloom.functions.clock import shift_hours
from barloom.operators.asof import carried_rows, last_so_far
from barloom.operators.series import with_slice
from barloom.session import shared_folder


@dataclass(frozen=True)
class Sliced:
    """A stored table: its ``rows`` with their ``_slice``, and ``ends`` with one row per key and slice,
    whose struct ``_last`` is the last row of the slice."""

    rows: DataFrame
    ends: DataFrame
    keys: tuple[str, ...]
    seconds: int
    buckets: int

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != "_slice"]


def write_sliced(
    df: DataFrame,
    table: str,
    buckets: int,
    keys: Sequence[str] = ("symbol",),
    layout: Layout = Layout(),
    lag: float = 0.0,
) -> Sliced:
    """Store ``df`` as the catalog table ``table`` and its ends as ``<table>_ends``, in the shared folder.

    Times are unique per key. A bucket is read by one task, so ``buckets`` grows with the rows: about
    rows / 1 million for bars. A key of any size is spread by its slices. ``lag`` in hours moves the
    times back to when a row is known. Both tables replace those of the same name.
    """
    if "_slice" in df.columns:
        raise ValueError("a column of the table is named _slice")
    spark, place = df.sparkSession, [*keys, "_slice"]
    rows = df.withColumn("time", shift_hours(F.col("time"), lag)) if lag else df
    facts = {"keys": list(keys), "seconds": layout.slice_seconds, "buckets": buckets}
    rows = with_slice(rows.select(*df.columns), layout).withMetadata("_slice", facts)
    _save(rows, table, buckets, place, [*place, "time"])
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    ends = spark.table(table).groupBy(*place).agg(F.max_by(whole, "time").alias("_last"))
    _save(ends, f"{table}_ends", buckets, place, place)
    return read_sliced(spark, table)


def _save(df: DataFrame, table: str, buckets: int, place: Sequence[str], order: Sequence[str]) -> None:
    """One file per bucket: rows are dealt out by the hash that names their bucket."""
    dealt = df.repartition(buckets, *place).sortWithinPartitions(*order)
    writer = dealt.write.mode("overwrite").option("path", shared_folder(df.sparkSession))
    writer.bucketBy(buckets, *place).sortBy(*order).saveAsTable(table)


def read_sliced(spark: SparkSession, table: str) -> Sliced:
    rows = spark.table(table)
    facts = rows.schema["_slice"].metadata
    return Sliced(rows, spark.table(f"{table}_ends"), tuple(facts["keys"]), facts["seconds"], facts["buckets"])


def drop_sliced(spark: SparkSession, table: str) -> None:
    """Take the tables out of the catalog; their files go with the products of the session."""
    for name in (table, f"{table}_ends"):
        spark.sql(f"drop table if exists {name}")


def asof_sliced(left: Sliced, rights: Sequence[tuple[Sliced, Sequence[str]]]) -> DataFrame:
    """Every row of ``left`` with the payload columns of the last row of each right table at or before
    its time, NULL where nothing came before; as ``asof_backward``, without shuffling a bar."""
    for right, _ in rights:
        if (right.keys, right.seconds, right.buckets) != (left.keys, left.seconds, left.buckets):
            raise ValueError("tables differ in their keys, the width of their slices or their buckets")
    keys, place = list(left.keys), [*left.keys, "_slice"]
    names = [f"_right{n}" for n in range(len(rights))]

    ends = left.ends.select(*place)
    for name, (right, payload) in zip(names, rights):
        last = F.struct(*[F.col("_last")[c].alias(c) for c in payload])
        ends = ends.unionByName(right.ends.select(*place, last.alias(name)), allowMissingColumns=True)
    carried = carried_rows(ends, keys, names).repartition(left.buckets, *place)

    # All sides have all columns in one order, those they lack as NULLs. Only projections lie between
    # the scans and the union, and the columns that name the bucket get plain names of their own:
    # Spark tells that the sides share their buckets only if no table name clings to these columns.
    types = {f.name: f.dataType for f in left.rows.schema.fields if f.name not in place}
    for name, (right, payload) in zip(names, rights):
        types[name] = right.rows.select(F.struct(*payload)).schema[0].dataType
    at = {c: f"_at{n}" for n, c in enumerate(place)}

    def side(df: DataFrame, number: int) -> DataFrame:
        columns = [
            F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()
        ]
        named = [F.col(f"`{c}`").alias(name) for c, name in at.items()]
        return df.select(*named, *columns, F.lit(number).alias("_side"))

    merged = side(left.rows, 2)
    for name, (right, payload) in zip(names, rights):
        merged = merged.union(side(right.rows.select(*place, "time", F.struct(*payload).alias(name)), 1))
    matched = last_so_far(merged.union(side(carried, 0)), list(at.values()), names)
    picked = [F.col(f"{name}.{c}").alias(c) for name, (_, payload) in zip(names, rights) for c in payload]
    return matched.select(*[F.col(f"`{at.get(c, c)}`").alias(c) for c in left.columns], *picked)
