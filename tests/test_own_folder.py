"""Queries in a session on one machine that goes without ``spark.checkpoint.dir``."""

import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barloom import session
from test_cluster import tables  # noqa: F401

NAMES = (
    "pipeline",
    "op1_quality_rules",
    "op2_fingerprints",
    "op3_substring_dedup",
    "op4_mixing",
    "op5_sharding",
    "op6_line_dedup",
    "op8_jaccard_join",
    "op9_url_filter",
    "op10_toxicity",
    "op11_alignment",
    "op12_hard_negatives",
    "op13_near_vectors",
    "asof_macro",
    "asof_sliced",
    "asof_multi_timeframe",
    "best_candidate",
    "bars_round_trip",
    "asof_when_known",
    "box_stats",
    "buy_and_hold",
    "clean_deliveries",
    "confirm_on_test",
    "daily_pnl",
    "entries",
    "equity_drawdown",
    "feat_ema_since",
    "feat_increments",
    "first_passage",
    "first_passage_long",
    "importance_filter",
    "forest_predictions",
    "forest_checks",
    "importance_table",
    "impurity_importance",
    "impurity_checks",
    "loss_breakdown",
)


@pytest.fixture(scope="module")
def every_table(spark, tables):  # noqa: F811
    """Beside orders and events, sixty documents with their labels, urls and vectors."""
    n = F.col("id")
    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), (n % 20 + i * i % 37) % 50))
    text = F.concat_ws("\n", F.concat_ws(" ", words), F.lit("a line of more than twenty characters"))
    docs = spark.range(60).select(
        n.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), n % 3).alias("source")
    )
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tables}/documents.parquet")
    spark.range(60).select(
        n.alias("doc_id"), (n % 2).cast("int").alias("quality"), (n % 20 < 5).cast("int").alias("toxic")
    ).write.parquet(f"{tables}/labels.parquet")
    spark.range(60).select(
        n.alias("page_id"), F.format_string("http://www.example.com/en/%d", n).alias("url"), F.lit("").alias("html")
    ).write.parquet(f"{tables}/pages.parquet")
    vector = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((n * i * 31 % 17) / 17).cast("float"))
    spark.range(210).select(
        n.alias("vec_id"), (n % 3).cast("int").alias("label"), vector.alias("embedding")
    ).write.parquet(f"{tables}/embeddings.parquet")
    return tables


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    """A session without the setting, as it reads its settings; Spark lets none be set. The folder in
    which its own one is made."""
    kind, folder = type(spark.conf), tmp_path_factory.mktemp("own")

    def get(self, key, *rest, plain=kind.get):
        return rest[0] if key == session.SETTING and rest else plain(self, key, *rest)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(kind, "get", get)
        patch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
        patch.setattr(session, "_own", {}, raising=False)
        patch.setattr(tempfile, "tempdir", str(folder))
        yield folder


@pytest.mark.parametrize("name", NAMES)
def test_products_of_a_query_lie_in_a_folder_of_its_own(spark, every_table, own, name):
    assert spark.conf.get(session.SETTING, None) is None
    with session.products(spark):
        found = __spark_entry__.queries()[name](spark, every_table)
        assert len(found.collect()) > 0
        assert [*own.glob("barloom-*/barloom-*")]
