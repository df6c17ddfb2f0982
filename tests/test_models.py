import pytest
from pyspark.sql import functions as F
from test_model import FOREST, SPLIT, table

from barloom.config import Forest, Split
from barloom.operators.filters import feature_columns
from barloom.plans import models
from barloom.plans.training import forest_scorer, impurity_importance, permutation_importance, predict_proba, train_forest
from barloom.session import exists


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """Each test begins without models."""
    monkeypatch.setattr(models, "shared_base", lambda spark: str(tmp_path))


def rows_of(model, data):
    return predict_proba(model, data, SPLIT.evaluation_years).orderBy("time").collect()


def test_one_fit_serves_all_scorers(spark, shared, monkeypatch):
    data = table(spark)
    names = feature_columns(data)
    plain, fits = train_forest(data, names, SPLIT, FOREST), []
    monkeypatch.setattr(models, "train_forest", lambda *a: (fits.append(a), train_forest(*a))[1])
    loaded = [models.stored_forest(data, names, SPLIT, FOREST) for _ in range(3)]
    assert len(fits) == 1
    for model in loaded[::2]:
        assert rows_of(model, data) == rows_of(plain, data)
        assert impurity_importance(model, names).collect() == impurity_importance(plain, names).collect()
    moved = [permutation_importance(forest_scorer(m), data, names, 2022, FOREST).collect() for m in (plain, loaded[0])]
    assert moved[0] == moved[1]
    # Other files and another order of the same rows are the same table.
    again = data.repartition(7).sortWithinPartitions("noise")
    assert models.model_path(again, names, SPLIT, FOREST) == models.model_path(data, names, SPLIT, FOREST)


def test_whatever_changes_the_fit_changes_the_key(spark, shared):
    data = table(spark)
    names = feature_columns(data)
    base = models.model_key(data, names, SPLIT, FOREST)
    late = F.col("time") == F.lit("2021-06-01").cast("timestamp_ntz")
    others = [
        (data.where(~late), names, SPLIT, FOREST),
        (data.withColumn("good", F.when(late, 1000.0).otherwise(F.col("good"))), names, SPLIT, FOREST),
        (data.withColumn("Target", F.when(late, (F.col("Target") + 2) % 3 - 1).otherwise(F.col("Target"))), names, SPLIT, FOREST),
        (data.unionByName(data.where(late)), names, SPLIT, FOREST),
        (data, names[::-1], SPLIT, FOREST),
        (data, names[:1], SPLIT, FOREST),
        (data, names, Split(2021, 2022, 2023, purge_hours=96), FOREST),
        (data, names, SPLIT, Forest(trees=10, depth=4, repeats=3)),
    ]
    assert len({base, *[models.model_key(*o) for o in others]}) == len(others) + 1
    # Rows outside the training span and the number of shuffles do not matter.
    later = data.where("year(time) < 2023")
    assert models.model_key(later, names, SPLIT, Forest(trees=10, depth=5, repeats=9)) == base


def test_a_fit_that_breaks_off_leaves_no_model(spark, shared, monkeypatch):
    data = table(spark)
    names = feature_columns(data)
    path = models.model_path(data, names, SPLIT, FOREST)

    class Broken:
        def write(self):
            return self

        def save(self, folder):
            (spark.range(3).write.parquet(f"{folder}/stages"))
            raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(models, "train_forest", lambda *a: Broken())
        with pytest.raises(OSError):
            models.stored_forest(data, names, SPLIT, FOREST)
    assert not exists(spark, path)
    assert models.stored_forest(data, names, SPLIT, FOREST).stages[-1].getNumTrees == FOREST.trees
    assert exists(spark, path)
