"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``points`` places on a ring of 64-bit hashes. A key belongs to the arc that ends at
the next place clockwise; if that place's shard is full, the arc's last keys continue clockwise to
the next place whose shard has room. What moves depends on the arcs' counts alone, so the counts
(one per place, however many keys there are) are collected, the overflow is worked out on them, and
every key finds its shard from its arc and its rank there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import document_key, stored

PIECES = "arc int, first long, last long, shard int, slot_from long"


@dataclass(frozen=True)
class Ring:
    """``headroom`` is how far above the mean a shard's count may go. At 0 the counts are at most
    one apart; with more, fewer keys leave their home when shards come or go."""

    shards: int = 40
    points: int = 128
    headroom: float = 0.0

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The ring's places in order and the shard of each."""
        names = [(s, f"shard {s} point {p}") for s in range(self.shards) for p in range(self.points)]
        at = np.array([xxhash.xxh64_intdigest(n) for _, n in names], dtype=np.uint64).view(np.int64)
        owner = np.array([s for s, _ in names])
        order = np.lexsort((owner, at))
        return at[order], owner[order]

    def capacities(self, total: int) -> list[int]:
        if self.headroom > 0:
            return [int(np.ceil((1 + self.headroom) * total / self.shards))] * self.shards
        return [total // self.shards + (s < total % self.shards) for s in range(self.shards)]


def arc_of(ring: Ring, position: Column) -> Column:
    """The arc, by its end place, of a 64-bit hash."""
    at, _ = ring.places()

    @F.pandas_udf("int")
    def arc(keys: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(at, keys.to_numpy()) % len(at)).astype(np.int32))

    return arc(position)


def overflow(ring: Ring, counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """``(arc, first, last, shard, slot_from)``: which ranks of each arc go to which shard.

    First every place takes its own arc, in ring order, as far as its shard has room; then the rest
    goes round clockwise. The room suffices for all keys, so two laps end it.
    """
    _, owner = ring.places()
    room = ring.capacities(sum(counts.values()))
    filled = [0] * ring.shards
    pieces: list[tuple[int, int, int, int, int]] = []

    def take(place: int, arc: int, first: int, last: int) -> int:
        shard = int(owner[place])
        n = min(last - first, room[shard] - filled[shard])
        if n > 0:
            pieces.append((arc, first, first + n, shard, filled[shard]))
            filled[shard] += n
        return first + max(n, 0)

    left = {}
    for arc in sorted(counts):
        first = take(arc, arc, 0, counts[arc])
        if first < counts[arc]:
            left[arc] = (arc, first, counts[arc])
    carried: list[tuple[int, int, int]] = []
    for step in range(2 * len(owner)):
        place = step % len(owner)
        if place in left and step < len(owner):
            carried.append(left[place])
        waiting, carried = carried, []
        for arc, first, last in waiting:
            first = take(place, arc, first, last)
            if first < last:
                carried.append((arc, first, last))
        if not carried and step >= len(owner):
            break
    return pieces


def sharded(rows: DataFrame, ring: Ring, position: str = "position", ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, gapless from 0 in each shard.

    ``position`` is a 64-bit hash of the key; rows with one position are ordered by ``ties``. Rows
    alike in all of these are interchangeable.
    """
    rows = stored(rows.withColumn("arc", arc_of(ring, F.col(position))))
    counts = {r.arc: r["count"] for r in rows.groupBy("arc").count().collect()}
    pieces = rows.sparkSession.createDataFrame(overflow(ring, counts), PIECES)
    order = Window.partitionBy("arc").orderBy(position, *ties)
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    # At most two pieces per place of the ring: bounded by its size.
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    placed = ranked.join(F.broadcast(pieces.withColumnRenamed("arc", "piece")), (F.col("arc") == F.col("piece")) & inside)
    slot = (F.col("slot_from") + F.col("rank") - F.col("first")).alias("slot")
    return placed.select(*[c for c in rows.columns if c not in ("arc", position)], "shard", slot)


def shard_report(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """Shard and slot of every row, with the counts of the shards at most one apart.

    A null text has no bytes; a null doc_id is hashed by its text, so that many of them spread.
    Repeated rows follow one another; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(document_key()).alias("position"),
    )
    placed = sharded(rows, ring, ties=("doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
