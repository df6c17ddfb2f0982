"""Fitted forests as products: fitted once, loaded by whatever scores with them.

A model lies under the shared folder by a key of everything that it depends on: the training rows,
the features and their order, the split and the forest's parameters. The key of the rows is a sum of
row hashes, so it needs one pass without a shuffle and does not depend on how rows lie in files.
"""

from __future__ import annotations

import hashlib
import json

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import Forest, Split
from barloom.operators.filters import purged_train_split
from barloom.plans.training import train_forest
from barloom.session import exists, moved, shared_base, shared_folder

FOLDER = "models"


def rows_key(rows: DataFrame, columns: Sequence[str]) -> str:
    """Equal for the same rows, however often each occurs, in any order."""
    hashes = [F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)") for seed in (0, 1)]
    found = rows.agg(F.count(F.lit(1)), *[F.sum(h) for h in hashes]).first()
    return ":".join("0" if x is None else str(x) for x in found)


def model_key(table: DataFrame, features: Sequence[str], split: Split, forest: Forest) -> str:
    train = purged_train_split(table, split)
    parts = {
        "rows": rows_key(train, ["symbol", "time", "Target", *features]),
        "features": list(features),
        "split": asdict(split),
        # How often a shuffle is repeated is no matter of the fit.
        "forest": {k: v for k, v in asdict(forest).items() if k != "repeats"},
        "spark": table.sparkSession.version,
    }
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def model_path(table: DataFrame, features: Sequence[str], split: Split, forest: Forest) -> str:
    return f"{shared_base(table.sparkSession)}/{FOLDER}/forest-{model_key(table, features, split, forest)}"


def stored_forest(
    table: DataFrame, features: Sequence[str], split: Split = Split(), forest: Forest = Forest()
) -> PipelineModel:
    """The forest of these rows and parameters, fitted and stored unless it already is.

    A model is written aside and renamed when it is whole, so a fit that breaks off leaves nothing
    that would be loaded. If two jobs fit the same model, the first one that is done is kept.
    """
    spark, path = table.sparkSession, model_path(table, features, split, forest)
    if not exists(spark, path):
        aside = shared_folder(spark)
        train_forest(table, features, split, forest).write().save(aside)
        moved(spark, aside, path)
    return PipelineModel.load(path)
