"""Training a random forest once and scoring all later years with it."""

from __future__ import annotations

import math

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import Forest, Split
from barloom.operators.filters import purged_train_split, require_rows, year_slice
from barloom.operators.scores import CLASSES, balanced_weights, percent
from barloom.operators.series import numbered
from barloom.session import stored

RANGE_ROWS = 65_536

# Tells the learner that there are three classes even where one does not occur in training.
LABEL_METADATA = {
    "ml_attr": {"type": "nominal", "name": "label", "vals": [str(c) for c in CLASSES]}
}


def class_index(label: Column) -> Column:
    return (label - CLASSES[0]).cast("double")


def train_forest(
    table: DataFrame, features: Sequence[str], split: Split = Split(), forest: Forest = Forest()
) -> PipelineModel:
    """Fit on the purged training span with balanced class weights; an error if it is empty."""
    train = require_rows(purged_train_split(table, split), split)
    weights = balanced_weights(train).select("Target", "class_weight")
    rows = train.join(F.broadcast(weights), "Target").select(  # one row per class
        *features,
        "class_weight",
        class_index(F.col("Target")).alias("label", metadata=LABEL_METADATA),
    )
    vectors = VectorAssembler(inputCols=list(features), outputCol="features")
    learner = RandomForestClassifier(
        numTrees=forest.trees,
        maxDepth=forest.depth,
        minInstancesPerNode=forest.min_leaf,
        maxBins=forest.bins,
        featureSubsetStrategy="sqrt",
        weightCol="class_weight",
        seed=forest.seed,
    )
    model = learner.fit(vectors.transform(rows).select("features", "label", "class_weight"))
    return PipelineModel([vectors, model])


def forest_of(model: PipelineModel) -> RandomForestClassificationModel:
    return model.stages[-1]


def predict_proba(model: PipelineModel, table: DataFrame, years: Sequence[int]) -> DataFrame:
    """Class and class probabilities of all rows of the given years, in one pass."""
    scored = model.transform(year_slice(table, years))
    p = vector_to_array("probability")
    return scored.select(
        "symbol",
        "time",
        "year",
        F.col("Target").cast("int").alias("y"),
        (F.col("prediction") + CLASSES[0]).cast("int").alias("yhat"),
        *[p[n].alias(c) for n, c in enumerate(("p_down", "p_flat", "p_up"))],
        F.col("Spread").alias("spread"),
    )


def impurity_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """One row per feature from the fitted model, in percent with two digits."""
    shares = forest_of(model).featureImportances.toArray()
    table = SparkSession.active().createDataFrame(
        [(f, float(v)) for f, v in zip(features, shares)], "feature string, share double"
    )
    return table.select("feature", percent(F.col("share")).alias("impurity_pct")).orderBy(
        F.col("impurity_pct").desc()
    )


Scorer = Callable[[DataFrame], DataFrame]


def forest_scorer(model: PipelineModel) -> Scorer:
    """Adds ``prediction`` (class index) to rows with an array of feature ``values``."""

    def score(rows: DataFrame) -> DataFrame:
        return forest_of(model).transform(rows.withColumn("features", array_to_vector("values")))

    return score


def numbered_rows(table: DataFrame, features: Sequence[str], year: int) -> DataFrame:
    """``row, label, values`` of a year, numbered from 0 in the order of a hash of the keys.

    Rows are ranked inside ranges of the hash, as many as keep a range at about ``RANGE_ROWS``
    rows, and what lies before a range is the sum of the range counts.
    """
    rows = year_slice(table, [year]).select(
        F.md5(F.concat_ws("|", "symbol", F.col("time").cast("string"))).alias("_hash"),
        class_index(F.col("Target")).alias("label"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("values"),
        F.lit(0).alias("_all"),
    )
    digits = 1
    total = rows.count()
    while 16**digits * RANGE_ROWS < total:
        digits += 1
    rows = rows.withColumn("_part", F.left("_hash", F.lit(digits)))
    return numbered(rows, ["_all"], ["_part"], ["_hash"], "row").select("row", "label", "values")


def bijection(total: int, *seeds: int) -> tuple[int, int]:
    """``a, b`` such that r -> (a * r + b) mod total maps the rows onto themselves."""
    state = 0
    for seed in seeds:
        state = (state * 1_000_003 + seed + 1) % 2_147_483_647
    a = 1 + state % max(total, 1)
    while math.gcd(a, total) != 1:
        a += 1
    return a, (state * 7_919 + 104_729) % max(total, 1)


def permutation_importance(
    score: Scorer,
    table: DataFrame,
    features: Sequence[str],
    year: int,
    forest: Forest = Forest(),
) -> DataFrame:
    """Mean and deviation of the loss in accuracy when one feature is shuffled.

    Rows are numbered once, in hash order. A shuffle sends the value of row r to row (a r + b) mod
    n with a coprime to n, which no sort is needed for, and only (row, value) moves: the values of
    all repeats of a feature meet their rows in one join. An empty year gives no rows.
    """
    names = list(features)
    rows = stored(numbered_rows(table, names, year))
    total = rows.count()
    if total == 0:
        return table.sparkSession.createDataFrame(
            [], "feature string, permutation_mean double, permutation_std double"
        )

    def accuracy_of(scored: DataFrame, place: int) -> DataFrame:
        right = (F.col("prediction") == F.col("label")).cast("double")
        by_repeat = scored.groupBy("repeat").agg(F.avg(right).alias("accuracy"))
        return by_repeat.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("sd")).select(
            F.lit(place).alias("place"), "mean", "sd"
        )

    # The untouched rows are place -1.
    scores = accuracy_of(score(rows.withColumn("repeat", F.lit(0))), -1)
    for place in range(len(names)):
        maps = [bijection(total, forest.seed, place, r) for r in range(forest.repeats)]
        moves = F.array(
            *[
                F.struct(F.lit(r).alias("repeat"), F.lit(a).cast("decimal(38,0)").alias("a"), F.lit(b).alias("b"))
                for r, (a, b) in enumerate(maps)
            ]
        )
        sent = rows.select("row", F.col("values")[place].alias("value"), F.inline(moves))
        to = F.expr(f"cast((a * row + b) % {total} as bigint)")
        sent = sent.select(to.alias("row"), "repeat", "value")
        kept = F.slice("values", place + 2, len(names))
        changed = F.concat(F.slice("values", 1, place), F.array("value"), kept)
        shuffled = rows.join(sent, "row").select("label", "repeat", changed.alias("values"))
        scores = scores.unionByName(accuracy_of(score(shuffled), place))
    # One list with an entry per feature.
    whole = scores.agg(F.collect_list(F.struct("place", "mean", "sd")).alias("_s"))
    base = F.filter("_s", lambda s: s["place"] == -1)[0]["mean"]
    return (
        whole.select(base.alias("_base"), F.inline("_s"))
        .where(F.col("place") >= 0)
        .select(
            F.array(*[F.lit(f) for f in names])[F.col("place")].alias("feature"),
            F.bround(F.col("_base") - F.col("mean"), 5).alias("permutation_mean"),
            F.bround("sd", 5).alias("permutation_std"),
        )
        .orderBy(F.col("permutation_mean").desc())
    )


def importance_table(impurity: DataFrame, permutation: DataFrame) -> DataFrame:
    """Both importances side by side; impurity alone where the validation year is empty."""
    return impurity.join(permutation, "feature", "left").orderBy(
        F.col("permutation_mean").desc_nulls_last(), F.col("impurity_pct").desc()
    )
