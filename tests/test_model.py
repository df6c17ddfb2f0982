import math

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.config import Forest, Split
from barloom.operators.filters import (
    feature_columns,
    importance_filter,
    purged_train_split,
    year_slice,
)
from barloom.operators.scores import (
    accuracy,
    balanced_weights,
    classification_report,
    prediction_table,
)
from barloom.plans.training import (
    bijection,
    forest_scorer,
    importance_table,
    impurity_importance,
    numbered_rows,
    permutation_importance,
    predict_proba,
    train_forest,
)

SPLIT = Split(train_end=2021, validate=2022, test=2023)
FOREST = Forest(trees=10, depth=5, repeats=3)


def table(spark, classes=(-1, 0, 1)):
    """Six-hourly rows of 2021 to 2023; the target follows ``good`` and ignores ``noise``."""
    rows = spark.range(4 * 365 * 3).select(
        F.lit("X").alias("symbol"),
        (F.lit("2021-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") * 6).cast("int"))).alias("time"),
        (F.xxhash64("id") % 100).cast("double").alias("good"),
        (F.xxhash64("id", F.lit("n")) % 100).cast("double").alias("noise"),
        F.lit(1.0).alias("Spread"),
    )
    choice = F.when(F.col("good") < -30, classes[0]).when(F.col("good") > 30, classes[-1]).otherwise(0)
    return rows.withColumn("Target", choice)


@pytest.fixture(scope="module")
def fitted(spark):
    data = table(spark).cache()
    names = feature_columns(data)
    return data, names, train_forest(data, names, SPLIT, FOREST)


def test_feature_columns_leave_out_keys_and_dropped(spark):
    data = table(spark).withColumn("Hour_Sin", F.lit(0.0))
    assert feature_columns(data) == ["good", "noise"]


def test_predictions_cover_both_years_and_sum_to_one(fitted):
    data, _, model = fitted
    scored = predict_proba(model, data, SPLIT.evaluation_years)
    assert {r.year: r["count"] for r in scored.groupBy("year").count().collect()} == {2022: 1460, 2023: 1460}
    off = scored.where(F.abs(F.col("p_down") + F.col("p_flat") + F.col("p_up") - 1) > 1e-9)
    assert off.count() == 0
    assert all(r.accuracy > 0.9 for r in accuracy(scored).collect())
    assert prediction_table(scored).columns[:4] == ["symbol", "time", "y", "yhat"]


def test_same_seed_same_result(fitted):
    data, names, model = fitted
    again = train_forest(data, names, SPLIT, FOREST)
    first, second = (
        predict_proba(m, data, [2022]).select("time", "p_up").orderBy("time").collect() for m in (model, again)
    )
    assert first == second


def test_importances_find_the_informative_feature(fitted):
    data, names, model = fitted
    impurity = {r.feature: r.impurity_pct for r in impurity_importance(model, names).collect()}
    assert impurity["good"] > impurity["noise"] and abs(sum(impurity.values()) - 100) < 0.05
    rows = permutation_importance(forest_scorer(model), data, names, 2022, FOREST).collect()
    assert [r.feature for r in rows] == ["good", "noise"]
    assert rows[0].permutation_mean > 0.3 > abs(rows[1].permutation_mean) + 0.2
    both = importance_table(impurity_importance(model, names), permutation_importance(forest_scorer(model), data, names, 2022, FOREST))
    assert [(r.feature, r.impurity_pct) for r in both.collect()] == [(f, impurity[f]) for f in ("good", "noise")]


def test_importances_without_a_validation_year(fitted):
    data, names, model = fitted
    none = permutation_importance(forest_scorer(model), data, names, 2035, FOREST)
    both = importance_table(impurity_importance(model, names), none).collect()
    assert [r.feature for r in both] == ["good", "noise"]
    assert all(r.permutation_mean is None and r.impurity_pct > 0 for r in both)


def test_a_shuffle_moves_every_value_once():
    for total in (1, 2, 12, 1460, 99991):
        for repeat in range(5):
            a, b = bijection(total, 42, 1, repeat)
            assert len({(a * r + b) % total for r in range(min(total, 5000))}) == min(total, 5000)
            assert math.gcd(a, total) == 1


def test_a_shuffle_by_rule_matches_a_loop(spark):
    data = table(spark)
    names = ["good", "noise"]

    def rule(rows):
        return rows.withColumn("prediction", F.when(F.col("values")[0] > 0, 2.0).otherwise(0.0))

    rows = [(r.row, r.label, r["values"]) for r in numbered_rows(data, names, 2022).collect()]
    n, by_row = len(rows), {r: (y, v) for r, y, v in rows}
    assert sorted(by_row) == list(range(n))
    want = {}
    for place, name in enumerate(names):
        scores = []
        for repeat in range(FOREST.repeats):
            a, b = bijection(n, FOREST.seed, place, repeat)
            moved = {(a * r + b) % n: v[place] for r, (_, v) in by_row.items()}
            first = [moved[r] if place == 0 else by_row[r][1][0] for r in range(n)]
            scores.append(sum((2.0 if x > 0 else 0.0) == by_row[r][0] for r, x in enumerate(first)) / n)
        base = sum((2.0 if v[0] > 0 else 0.0) == y for y, v in by_row.values()) / n
        want[name] = round(base - sum(scores) / len(scores), 5)
    found = {r.feature: r.permutation_mean for r in permutation_importance(rule, data, names, 2022, FOREST).collect()}
    assert found == pytest.approx(want, abs=1e-5)


def test_a_class_missing_in_training_has_probability_zero(spark):
    data = table(spark, classes=(-1, 0, 0))
    scored = predict_proba(train_forest(data, ["good"], SPLIT, FOREST), data, [2022])
    assert scored.agg(F.max("p_up"), F.max("p_down")).first()[0] == 0.0


def test_empty_training_span_is_an_error(spark):
    with pytest.raises(ValueError):
        train_forest(table(spark), ["good"], Split(train_end=2019), FOREST)


def test_purge_by_hours_and_by_bars(spark):
    data = table(spark)
    last = purged_train_split(data, SPLIT).agg(F.max("time")).first()[0]
    assert last == datetime(2022, 1, 1) - timedelta(hours=54)
    bars = Split(2021, 2022, 2023, purge_bars=24)
    kept = purged_train_split(data.drop("year"), bars)
    assert kept.count() == 1460 - 24


def test_year_slice_is_half_open(spark):
    years = year_slice(table(spark), [2022]).agg(F.min("time"), F.max("time")).first()
    assert years[0] == datetime(2022, 1, 1) and years[1] < datetime(2023, 1, 1)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(-1,)] * 1 + [(0,)] * 3 + [(1,)] * 4, "Target int")
    got = {r.Target: (r.n, r.class_weight) for r in balanced_weights(df).collect()}
    assert got == {-1: (1, 8 / 3), 0: (3, 8 / 9), 1: (4, 8 / 12)}


def test_report_without_hits_or_predictions(spark):
    pairs = [(1, 1), (1, 0), (0, 0), (-1, 0)]
    df = spark.createDataFrame([(2024, *p) for p in pairs], "year int, y int, yhat int")
    got = {r.label: r for r in classification_report(df).collect()}
    assert (got["-1"].precision, got["-1"].recall, got["-1"].f1, got["-1"].support) == (0.0, 0.0, 0.0, 1)
    assert (got["1"].precision, got["1"].recall) == (1.0, 0.5)
    assert abs(got["0"].precision - 1 / 3) < 1e-12 and got["0"].recall == 1.0
    assert abs(got["macro avg"].recall - 0.5) < 1e-12 and got["macro avg"].support == 4
    assert abs(got["weighted avg"].recall - 0.5) < 1e-12


def test_importance_rule_keeps_the_boundary(spark):
    rows = [("a", 2.0, 1.0), ("b", 1.9, 1.0), ("c", -1.0, 0.1)]
    df = spark.createDataFrame(rows, "feature string, permutation_mean double, permutation_std double")
    assert [r.feature for r in importance_filter(df).collect()] == ["a"]
