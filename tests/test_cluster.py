"""Queries in a session that takes itself for a cluster whose ``spark.checkpoint.dir`` is a bare path."""

import pytest
from pyspark.sql import functions as F

from barloom import session
from barloom.checks.queries import QUERIES

NAMES = (
    "asof_macro",
    "asof_multi_timeframe",
    "asof_when_known",
    "asof_sliced",
    "bars_round_trip",
    "best_candidate",
    "box_stats",
    "confirm_on_test",
    "buy_and_hold",
    "clean_deliveries",
    "daily_pnl",
    "feat_ema_since",
    "entries",
    "feat_increments",
    "equity_drawdown",
    "first_passage_long",
    "first_passage",
    "forest_predictions",
    "forest_checks",
    "loss_breakdown",
    "impurity_importance",
    "importance_filter",
    "impurity_checks",
    "importance_table",
)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Ten years of daily orders of three priorities, and four days of events of three types."""
    folder = str(tmp_path_factory.mktemp("tables"))
    key, day = F.col("id"), F.expr("timestamp'1992-01-01' + make_dt_interval(int(id div 3))")
    spark.range(3 * 3700).select(
        key.alias("o_orderkey"),
        (key * 31 % 997).alias("o_custkey"),
        F.lit("O").alias("o_orderstatus"),
        (key * 7919 % 500_000).cast("double").alias("o_totalprice"),
        day.alias("o_orderdate"),
        F.expr("element_at(array('1-URGENT', '2-HIGH', '5-LOW'), int(id % 3) + 1)").alias("o_orderpriority"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(3 * 96).select(
        key.alias("event_id"),
        F.expr("timestamp'2024-01-01' + make_dt_interval(0, int(id div 3))").alias("ts"),
        (key % 10).alias("user_id"),
        F.expr("element_at(array('purchase', 'click', 'view'), int(id % 3) + 1)").alias("event_type"),
        (key * 37 % 101).cast("double").alias("value"),
        F.format_string('{"k": %d}', key % 9).alias("props"),
    ).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_products_of_a_query_lie_in_the_warehouse(spark, tables, tmp_path, monkeypatch, name):
    spark.conf.set("barloom.test.warehouse", f"file:{tmp_path}/tables")
    monkeypatch.setattr(session, "WAREHOUSE", "barloom.test.warehouse", raising=False)
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[2,1,1024]")
    assert spark.conf.get("spark.checkpoint.dir").startswith("/")
    with session.products(spark):
        found = QUERIES[name](spark, tables)
        assert len(found.collect()) > 0
        assert [*(tmp_path / "tables").iterdir()]
