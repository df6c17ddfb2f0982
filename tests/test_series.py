from helpers import START, bars_frame, random_walk
from pyspark.sql import functions as F

from barloom.config import Layout
from barloom.functions.clock import bucket, time_of
from barloom.operators.series import Blocks, Decay, decaying_sums, layout_for, with_position


def test_positions_count_from_zero_in_time_order(spark):
    rows = random_walk(300, seed=2)
    both = bars_frame(spark, rows).unionByName(bars_frame(spark, rows[:100], symbol="Y"))
    for layout in (Layout(), Layout(slice_seconds=3_600 * 5)):
        got = with_position(both, ["symbol", "timeframe"], layout).collect()
        for symbol, n in (("X", 300), ("Y", 100)):
            mine = sorted((r.time, r.pos) for r in got if r.symbol == symbol)
            assert [p for _, p in mine] == list(range(n))


def test_blocks_copy_the_rows_their_windows_need(spark):
    df = spark.range(100).select(F.lit("X").alias("symbol"), F.col("id").alias("pos"))
    blocks = Blocks(("symbol",), back=5, ahead=3, layout=Layout(block_rows=16, sub_rows=4))
    spread = blocks.spread(df)
    held = {r._block: sorted(x) for r, x in (
        (r, r.rows) for r in spread.groupBy("_block").agg(F.collect_list("pos").alias("rows")).collect()
    )}
    assert held[2] == list(range(32 - 8, 48 + 3))
    own = blocks.own_rows(spread).collect()
    assert sorted(r.pos for r in own) == list(range(100))


def test_a_hot_symbol_is_spread_over_many_groups(spark):
    df = spark.range(10_000).select(F.lit("X").alias("symbol"), F.col("id").alias("pos"))
    blocks = Blocks(("symbol",), back=8, ahead=24, layout=Layout(block_rows=512, sub_rows=8))
    largest = blocks.spread(df).groupBy("symbol", "_block").count().agg(F.max("count")).first()[0]
    assert largest <= 512 + 8 + 24


def test_decaying_sum_is_the_recurrence(spark):
    factor, y, expected = 0.9, 0.0, []
    for i in range(500):
        y = factor * y + (i % 7)
        expected.append(y)
    df = spark.range(500).select(
        F.lit("X").alias("symbol"), F.col("id").alias("pos"), (F.col("id") % 7).cast("double").alias("x")
    )
    layout = Layout(block_rows=128, sub_rows=16)
    scan = Decay("x", factor)
    blocks = Blocks(("symbol",), scan.pieces(layout) * 16, 0, layout)
    got = blocks.own_rows(decaying_sums(blocks.spread(df), blocks, {"y": scan}))
    for row in got.collect():
        assert abs(row.y - expected[row.pos]) < 1e-12 * max(1.0, expected[row.pos])


def test_fast_decay_shortens_the_pieces():
    assert layout_for(Layout(), [0.8]).sub_rows == 2_048
    assert layout_for(Layout(), [0.2]).sub_rows == 256


def test_time_arithmetic_ignores_the_session_zone(spark):
    df = bars_frame(spark, [(0, 1, 1, 1), (2_500, 1, 1, 1)])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        back = df.withColumn("_b", bucket("time", 3_600)).select("time", time_of("(_b * 3600)").alias("t"))
        rows = back.collect()
        assert all(r.time == r.t for r in rows)
        assert START in {r.t for r in rows}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
