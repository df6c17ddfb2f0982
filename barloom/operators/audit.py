"""Row counts before and after a step, and missing values after a join, as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loss_columns(before: Column, after: Column, threshold_pct: float = 5.0) -> dict[str, Column]:
    """Change, lost share in percent (gains count as none) and the flag above the threshold."""
    lost = F.greatest(before - after, F.lit(0))
    pct = F.coalesce(F.try_divide(lost.cast("double"), before.cast("double")), F.lit(0.0)) * 100
    return {"delta": after - before, "lost_pct": pct, "flagged": pct > threshold_pct}


def row_loss_audit(
    chains: Sequence[Sequence[tuple[str, DataFrame]]],
    keys: Sequence[str] = (),
    threshold_pct: float = 5.0,
) -> DataFrame:
    """Per step and per ``keys``: rows before, rows after, what is lost.

    A chain is a list of stages (step that leads to it, table), the first one a start without a
    step of its own. Every stage is counted once and paired with the stage before it.
    """
    parts = []
    for chain, stages in enumerate(chains):
        for place, (step, df) in enumerate(stages):
            counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            at = [F.lit(chain).alias("_chain"), F.lit(place).alias("_place"), F.lit(step).alias("step")]
            parts.append(counted.select(*at, *keys, "n"))
    counts = reduce(DataFrame.unionByName, parts)
    if keys:  # a key that is lost as a whole still has a row at every later stage
        stages = counts.select("_chain", "_place", "step").distinct()
        held = counts.select("_chain", *keys).distinct().join(stages, "_chain")
        counts = held.join(counts, ["_chain", "_place", "step", *keys], "left").na.fill(0, ["n"])
    order = Window.partitionBy("_chain", *keys).orderBy("_place")
    paired = counts.withColumn("before", F.lag("n").over(order)).where(F.col("_place") > 0)
    table = paired.select("step", *keys, F.coalesce("before", F.lit(0)).alias("before"), F.col("n").alias("after"))
    return table.withColumns(loss_columns(F.col("before"), F.col("after"), threshold_pct))


def merge_null_audit(
    joined: DataFrame, probes: dict[str, str], threshold_pct: float = 5.0
) -> DataFrame:
    """Per joined table (label -> probe column): rows, missing probes, their share, the flag.

    All probes are counted in one pass over ``joined``.
    """
    counts = joined.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(probes.values())],
    )
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("merge"), F.lit(c).alias("probe"), F.col(f"_n{i}").alias("nulls"))
            for i, (label, c) in enumerate(probes.items())
        ]
    )
    share = F.try_divide(F.col("nulls").cast("double"), F.col("total").cast("double"))
    pct = F.coalesce(share, F.lit(0.0)) * 100
    return (
        counts.select("total", F.explode(rows).alias("_row"))
        .select("_row.merge", "_row.probe", "total", "_row.nulls")
        .withColumns({"null_pct": pct, "flagged": pct > threshold_pct})
    )
