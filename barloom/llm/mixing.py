"""Mixing sources to target weights by distributed prefix sums.

Every row gets a hash-random key. Within a source, rows are ordered by the key: first by bucket
(the key's first digits), then within the bucket. Prefix sums run over the bucket totals of a
source and then inside each bucket, so that a source of any size is spread over many tasks and no
task ever holds more than a bucket. A source's budget is cut at that running sum, exactly.

DataFrame functions only. Keys are MD5 digests, the same on every engine.
"""

from __future__ import annotations

import hashlib

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, stored


@dataclass(frozen=True)
class Mixture:
    """``weights`` are dealt to the sources in code point order (null last), again and again.

    A source gives at most ``repeats`` times its size. ``bucket_digits`` hexadecimal digits of the
    key make a bucket, and more where a bucket of a source could hold over ``bucket_rows`` rows on
    average; how long buckets are changes no result.
    """

    weights: tuple[int, ...] = (1, 2, 3)
    repeats: int = 3
    bucket_digits: int = 3
    bucket_rows: int = 4_096
    seed: str = "mix"

    def digits(self, rows: int) -> int:
        """Digits that make a bucket in a table of so many rows, all of which may be of one source."""
        digits = self.bucket_digits
        while rows > self.bucket_rows * 16**digits:
            digits += 1
        return digits


def size_of(text: str | Column) -> Column:
    """Number of words; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """Size, weight and target of every source.

    The targets add up to all sizes and follow the weights, but stop at ``repeats`` times the
    source's size; what is over goes to the others by weight until none is above. Sources are
    filled in order of cap / weight, so the ones that stop are a prefix of that order, and one
    pass over one row per source is enough.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.array(*[F.lit(w) for w in mixture.weights])
    place = (F.row_number().over(by_name) - 1) % len(mixture.weights)
    sources = sources.select(
        "source",
        "source_size",
        F.get(deal, place).cast("long").alias("weight"),
        (F.col("source_size") * mixture.repeats).alias("cap"),
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    sources = sources.withColumns(
        {
            "room": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "shares": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # A source stops if its share of what is left reaches its cap.
    sources = sources.withColumn("stops", F.col("weight") * F.col("room") >= F.col("cap") * F.col("shares"))
    room = F.sum("source_size").over(everything) - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(everything)
    shares = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(everything)
    share = F.col("weight").cast("double") * room.cast("double") / F.when(shares > 0, shares).otherwise(1).cast("double")
    return sources.select(
        "source",
        "source_size",
        F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target"),
    )


def mixed(
    rows: DataFrame, mixture: Mixture = Mixture(), id_column: str = "doc_id", ties: tuple[str, ...] = ()
) -> DataFrame:
    """``rows`` (with ``source`` and ``size``) and what the mix takes of each.

    Adds source_size, target, ``taken`` (the words taken, repeats counted), ``epochs`` (whole
    copies) and ``part`` (words of one more copy, cut where the source's budget ends). The budget
    is the target rounded to whole words. Rows that share an id are taken in order of their size, then
    of the columns ``ties``. Rows without an id share one key, and lie in a bucket for each size.
    """
    id_text = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    key = F.md5(F.concat(F.lit(mixture.seed + ":"), id_text))
    no_id = hashlib.md5(f"{mixture.seed}:null".encode()).hexdigest()
    # One name for source and bucket, null source included: rows are shuffled by it once, for the
    # join with what lies before the bucket and for the running sum inside it.
    # Their names sort as (key, size) do: the bucket with the key of rows without an id has keys below,
    # that key by size, and keys above.
    bucket = F.left(key, F.lit(mixture.digits(rows.count())))
    by_size = F.concat(F.lit("1"), F.lpad(F.col("size").cast("string"), 19, "0"))
    side = F.when(key < no_id, F.lit("0")).when(key == no_id, by_size).otherwise(F.lit("2"))
    place = F.concat(bucket, side, F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    keyed = rows.withColumns({"__key": key, "__place": place})
    buckets = keyed.groupBy("__place", "source").agg(F.sum("size").alias("bucket_size"))
    buckets = stored(buckets)
    targets = stored(source_targets(buckets.withColumnRenamed("bucket_size", "size"), mixture))
    order = Window.partitionBy("source").orderBy("__place")
    ahead = F.coalesce(
        F.sum("bucket_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = buckets.select("__place", F.col("source").alias("__s"), ahead.alias("__ahead"))
    targets = targets.withColumnRenamed("source", "__t")
    offsets = offsets.join(targets, F.expr("__s <=> __t")).drop("__s", "__t")
    joined = keyed.join(offsets, "__place")
    inside = Window.partitionBy("__place").orderBy("__key", "size", *ties)
    prior = F.coalesce(
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    joined = joined.withColumn("__before", F.col("__ahead") + prior)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("__budget div source_size")).otherwise(0)
    joined = joined.withColumn("__budget", budget).withColumn("epochs", whole.cast("long"))
    rest = F.col("__budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__before")))
    joined = joined.withColumn("part", part.cast("long"))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    return joined.select(*rows.columns, "source_size", "target", taken, "epochs", "part")


def mix_report(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """What the mix takes of each document. A null text has size 0; a null source is a source of
    its own; an empty table gives an empty result; other columns are not read."""
    rows = stored(docs.select("doc_id", "source", size_of("text").alias("size")))
    return mixed(rows, mixture).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes it, never torn.

    Rows that share an id and a size are taken in order of a hash of their text. The copy in which a
    source's budget ends is kept if at least half of it lies within. Columns
    are those of ``docs``, and columns of other names stay as they are.
    """
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"),
        F.col("doc_id").alias("doc_id"),
        F.col("source").alias("source"),
        size_of("text").alias("size"),
        F.xxhash64("text").alias("body"),
    )
    part = (F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))
    copies = F.col("epochs") + F.when(part, 1).otherwise(0)
    taken = mixed(packed, mixture, ties=("body",)).withColumn("__copies", copies).where("__copies > 0")
    taken = taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select("__row.*")
