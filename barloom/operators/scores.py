"""Class weights, the prediction table and classification scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = (-1, 0, 1)


def balanced_weights(train: DataFrame, label: str = "Target") -> DataFrame:
    """Per class: rows and n / (classes * rows). One row per class."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One list with an entry per class.
    whole = counts.agg(F.collect_list(F.struct(label, "n")).alias("_c"))
    total = F.aggregate("_c", F.lit(0).cast("bigint"), lambda sum_, c: sum_ + c["n"])
    weight = total / (F.size("_c") * F.col("n"))
    return (
        whole.select("_c", F.inline("_c")).withColumn("class_weight", weight).drop("_c")
    )


def percent(p: Column) -> Column:
    return F.bround(p * 100, 2)


def prediction_table(scored: DataFrame) -> DataFrame:
    """True class, predicted class, class percentages with two digits, and the spread.

    ``scored`` has y, yhat, spread and the class probabilities p_down, p_flat and p_up.
    """
    return scored.select(
        "symbol",
        "time",
        "y",
        "yhat",
        percent(F.col("p_down")).alias("conf_down"),
        percent(F.col("p_flat")).alias("conf_flat"),
        percent(F.col("p_up")).alias("conf_up"),
        "spread",
    )


def accuracy(predictions: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("support"),
        F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("accuracy"),
    )


def classification_report(predictions: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Precision, recall, F1 and support per class, with their plain and weighted means.

    The rows are reduced to the confusion counts first, nine at most per key.
    """
    keys = list(keys)
    confusion = predictions.groupBy(*keys, "y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    either = F.explode(
        F.array(
            F.struct(F.col("y").alias("label"), F.lit(1).alias("is_true")),
            F.struct(F.col("yhat").alias("label"), F.lit(0).alias("is_true")),
        )
    )
    sides = confusion.select(*keys, "y", "yhat", "n", either.alias("_s")).select("*", "_s.*")
    true_side = F.col("is_true") == 1
    zero = F.lit(0)
    per_class = sides.groupBy(*keys, "label").agg(
        F.sum(F.when(true_side, F.col("n")).otherwise(zero)).alias("support"),
        F.sum(F.when(~true_side, F.col("n")).otherwise(zero)).alias("predicted"),
        F.sum(F.when(true_side & (F.col("y") == F.col("yhat")), F.col("n")).otherwise(zero)).alias("hits"),
    )

    def share(of: Column) -> Column:
        return F.coalesce(F.try_divide(F.col("hits").cast("double"), of.cast("double")), F.lit(0.0))

    per_class = per_class.withColumns(
        {"precision": share(F.col("predicted")), "recall": share(F.col("support"))}
    )
    both = F.col("precision") + F.col("recall")
    f1 = F.coalesce(F.try_divide(F.col("precision") * F.col("recall") * 2, both), F.lit(0.0))
    per_class = per_class.withColumn("f1", f1)
    scores = ("precision", "recall", "f1")
    total = F.sum("support").cast("double")
    macro = per_class.groupBy(*keys).agg(
        F.sum("support").alias("support"), *[F.avg(c).alias(c) for c in scores]
    )
    weighted = per_class.groupBy(*keys).agg(
        F.sum("support").alias("support"),
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in scores],
    )
    out = [*keys, "label", "support", *scores]
    parts = [
        per_class.withColumn("label", F.col("label").cast("string")),
        macro.withColumn("label", F.lit("macro avg")),
        weighted.withColumn("label", F.lit("weighted avg")),
    ]
    return parts[0].select(*out).unionByName(parts[1].select(*out)).unionByName(parts[2].select(*out))
