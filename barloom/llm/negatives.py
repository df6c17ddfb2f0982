"""Hard negatives of anchors among all rows, by exact integer inner products.

Anchors are a stated set of rows, compared with all rows in blocks: rows and anchors are dealt to a
grid of bounded cells, and a cell passes on only the few best of each anchor. Within a cell scores
come from Kronecker-packed products: component j of all the cell's candidates, made non-negative by
a bias, lies in separate fields of one wide integer; that integer is multiplied once by component j
of the anchor, the products add up over j, and each field of the sum is one candidate's exact score
plus what the biases add, which is known from the plain sums.
"""

from __future__ import annotations

import operator

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stored


@dataclass(frozen=True)
class NegativeRule:
    """``positives`` nearest rows of the anchor's label; for each the first ``negatives`` rows of
    other labels that score between ``low`` and ``high`` percent of it. Components are multiplied by
    ``scale`` and rounded down. A cell holds ``block`` rows and as many anchors, about."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    block: int = 4096


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, vec``: one row per id, its components as whole numbers.

    Rows without an id, a label or a vector, or with a component that is null or not finite, are left
    out. Of rows that share an id the one with the smallest label, then the smallest vector, stays.
    """

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    fit = rows.where("vec_id is not null and label is not null and embedding is not null")
    fit = fit.where(~F.exists("embedding", bad))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    own = F.struct(F.col("label").cast("long").alias("label"), vec.alias("vec"))
    one = fit.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(own).alias("own"))
    return one.select("vec_id", "own.label", "own.vec")


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of the given width; shorter vectors end in zeros."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def width_of(*tables: pa.Table) -> int:
    return max((max(pa.compute.list_value_length(t["vec"]).to_pylist(), default=0) for t in tables), default=0)


@dataclass(frozen=True)
class Packed:
    """Candidates as one wide integer per component. Fields are 4, 8 or 16 bytes wide, whatever the
    largest sum needs, so none runs over into the next."""

    columns: list[int]
    field: int
    count: int
    low: int
    sums: np.ndarray
    anchor_low: int

    @staticmethod
    def of(candidates: np.ndarray, anchors: np.ndarray) -> Packed:
        low, anchor_low = int(candidates.min(initial=0)), int(anchors.min(initial=0))
        most = (int(candidates.max(initial=0)) - low) * (int(anchors.max(initial=0)) - anchor_low)
        bits = (most * max(1, candidates.shape[1])).bit_length()
        field = 4 if bits <= 32 else 8 if bits <= 64 else 16
        fields = np.zeros((candidates.shape[1], candidates.shape[0], max(1, field // 8)), dtype=f"<u{min(field, 8)}")
        fields[:, :, 0] = (candidates.T - low).astype(fields.dtype)
        columns = [int.from_bytes(c.tobytes(), "little") for c in fields]
        return Packed(columns, field, len(candidates), low, candidates.sum(axis=1), anchor_low)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products with an anchor, as far as they fit a long."""
        biased = [x - self.anchor_low for x in anchor.tolist()]
        total = sum(map(operator.mul, self.columns, biased))
        data = total.to_bytes(self.field * self.count + 8, "little")
        fields = np.frombuffer(data, dtype=f"<u{min(self.field, 8)}", count=self.count * max(1, self.field // 8))
        found = fields[:: max(1, self.field // 8)].astype(np.uint64).view(np.int64)
        plain = self.low * (sum(anchor.tolist()) - len(biased) * self.anchor_low)
        return found + self.anchor_low * self.sums + np.array([plain % 2**64], dtype=np.uint64).view(np.int64)


def first(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the highest scores, highest first, ties by place."""
    places = np.arange(len(scores))
    if len(scores) > count:
        least = np.partition(scores, len(scores) - count)[len(scores) - count]
        sure = np.flatnonzero(scores > least)
        places = np.concatenate([sure, np.flatnonzero(scores == least)[: count - len(sure)]])
    return places[np.lexsort((places, -scores[places]))]


POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def listed(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("vec_id")


def nearest_positives(rule: NegativeRule) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def of_cell(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        candidates, width = ordered(candidates), width_of(candidates, anchors)
        labels = candidates["label"].to_numpy()
        ids, vectors = candidates["vec_id"].to_numpy(), matrix(candidates["vec"], width)
        own_labels, own = anchors["label"].to_numpy(), matrix(anchors["vec"], width)
        for label in np.intersect1d(labels, own_labels):
            same = labels == label
            of_label = np.flatnonzero(own_labels == label)
            packed, names = Packed.of(vectors[same], own[of_label]), ids[same]
            for n in of_label:
                anchor, scores = anchors["vec_id"][int(n)].as_py(), packed.scores(own[n])
                other = np.flatnonzero(names != anchor)
                best = other[first(scores[other], rule.positives)]
                rows += [(anchor, int(names[k]), int(scores[k])) for k in best]
        return listed(rows, POSITIVES)

    return of_cell


def best_negatives(rule: NegativeRule) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def of_cell(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if not candidates.num_rows or not anchors.num_rows:
            return listed(rows, NEGATIVES)
        candidates, width = ordered(candidates), width_of(candidates, anchors)
        labels, ids = candidates["label"].to_numpy(), candidates["vec_id"].to_numpy()
        own = matrix(anchors["vec"], width)
        packed = Packed.of(matrix(candidates["vec"], width), own)
        wanted = zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), anchors["positives"].to_pylist())
        for n, (anchor, label, positives) in enumerate(wanted):
            scores = packed.scores(own[n])
            other = np.flatnonzero(labels != label)
            values = scores[other]
            for positive in positives:
                score = positive["positive_score"]
                least, most = -(-rule.low * score // 100), rule.high * score // 100
                inside = np.flatnonzero((values >= least) & (values <= most))
                best = other[inside[first(values[inside], rule.negatives)]]
                rows += [(anchor, positive["positive_id"], int(ids[k]), score, int(scores[k])) for k in best]
        return listed(rows, NEGATIVES)

    return of_cell


def dealt(name: str, count: int, block: int) -> Column:
    """A block number from a hash of the id."""
    return F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-count // block)))).alias(name)


def all_of(name: str, count: int, block: int) -> Column:
    """Every block number, as many rows."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-count // block)) - 1).cast("long"))).alias(name)


def hard_negatives(rows: DataFrame, anchors: Column, rule: NegativeRule = NegativeRule()) -> DataFrame:
    """For each row where ``anchors`` holds and each of its positives, the rows of other labels that
    score next below it.

    Rows come as ``vec_id, label, embedding``; what takes part is told by ``whole_vectors``: rows that
    are incomplete do not, repeated ids count once. Higher scores come first, ties by the smaller id.
    Vectors of different lengths are compared as if the shorter ended in zeros. An anchor without
    another row of its label, or without a row in the range, gives no rows, and so does an empty
    table. Other columns are not read. Scores beyond a long are not supported.
    """
    taken = stored(whole_vectors(rows, rule.scale))
    chosen = taken.where(anchors)
    many, few = taken.count(), chosen.count()
    cell = ["block", "group"]
    candidates = taken.select("*", dealt("block", many, rule.block)).select("*", all_of("group", few, rule.block))

    def meet(own: DataFrame, function: Callable, schema: str) -> DataFrame:
        own = own.select("*", dealt("group", few, rule.block)).select("*", all_of("block", many, rule.block))
        return candidates.groupBy(*cell).cogroup(own.groupBy(*cell)).applyInArrow(function, schema)

    near = meet(chosen, nearest_positives(rule), POSITIVES)
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= rule.positives)
    listed_near = F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")
    near = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(listed_near)
    found = meet(stored(chosen.join(near, "vec_id")), best_negatives(rule), NEGATIVES)
    by_score = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= rule.negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
