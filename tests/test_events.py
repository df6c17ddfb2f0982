import random

import pytest
from helpers import START, bars_frame, loop_trades, random_walk
from pyspark.sql import functions as F

from barloom.config import Account, Barriers, Layout
from barloom.functions.trading import normalise_threshold, weight_step
from barloom.operators.events import (
    TRADE_SCHEMA,
    enrich_trades,
    first_passage,
    non_overlapping_events,
    semi_join_entries,
    trade_pnl,
    trades_table,
    with_signals,
)

BARRIERS = Barriers(20, 10, 6, 1.0)


def with_side(spark, rows, sides, symbol="X"):
    bars = bars_frame(spark, rows, symbol)
    by_time = {START.timestamp() + 3_600 * r[0]: s for r, s in zip(rows, sides)}
    data = [(symbol, START.fromtimestamp(t), s) for t, s in by_time.items()]
    marks = spark.createDataFrame(data, "symbol string, time timestamp_ntz, signal int")
    return bars.join(marks, ["symbol", "time"]).withColumns(
        {"year": F.year("time"), "proba_max": F.lit(0.5)}
    )


def run(spark, rows, sides, barriers=BARRIERS, layout=Layout(), **sizes):
    signals = with_side(spark, rows, sides)
    found = first_passage(signals, barriers, layout=layout)
    kept = non_overlapping_events(found, barriers.window, **sizes)
    return [(r.pos, r.result, r.free_at) for r in kept.orderBy("year", "pos").collect()]


def series(*bars):
    return [(i, *bar) for i, bar in enumerate(bars)]


FLAT = (100, 100, 100)


def test_stop_before_target_on_one_bar(spark):
    rows = series(FLAT, (120, 90, 100), FLAT)
    assert run(spark, rows, [1, 0, 0]) == [(0, "loss_sl", 1)]


def test_exit_bar_may_open_the_next_trade(spark):
    rows = series(FLAT, (120, 100, 110), (110, 110, 110), (130, 110, 120))
    assert run(spark, rows, [1, 1, 1, 0]) == [(0, "win", 1), (1, "win", 3)]


def test_timeout_after_the_whole_window(spark):
    rows = series(*[FLAT] * 9)
    assert run(spark, rows, [1] * 9) == [(0, "loss_timeout", 6), (6, "loss_sl", 9)]


def test_series_that_ends_inside_a_trade_counts_as_stopped(spark):
    rows = series(FLAT, FLAT, FLAT)
    assert run(spark, rows, [0, -1, 1]) == [(1, "loss_sl", 3)]


def test_exactly_window_bars_left_is_a_timeout(spark):
    rows = series(*[FLAT] * 7)
    assert run(spark, rows, [1] + [0] * 6) == [(0, "loss_timeout", 6)]


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "fan": 4}, {"block": 4, "fan": 2}])
@pytest.mark.parametrize("density", [0.1, 0.6, 1.0])
def test_same_as_one_trade_at_a_time(spark, sizes, density):
    rng = random.Random(7)
    rows = random_walk(400, seed=int(density * 10), gap=False)
    sides = [rng.choice([1, -1]) if rng.random() < density else 0 for _ in rows]
    barriers = Barriers(35, 20, 12, 1.0)
    layout = Layout(3_600 * 9, 64, 16) if sizes else Layout()
    assert run(spark, rows, sides, barriers, layout, **sizes) == loop_trades(rows, sides, 35, 20, 12)


@pytest.mark.parametrize("start", range(3))
def test_signals_on_every_bar_of_a_flat_series(spark, start):
    """Every trade times out, so the first signal alone decides about all later ones."""
    rows = series(*[FLAT] * 90)
    sides = [0] * start + [1] * (90 - start)
    want = loop_trades(rows, sides, 20, 10, 6)
    assert run(spark, rows, sides, block=8, fan=3) == want


def test_years_are_separate(spark):
    rows = [(24 * 366 - 2 + i, 100, 100, 100) for i in range(6)]
    signals = with_side(spark, rows, [1] * 6)
    kept = non_overlapping_events(first_passage(signals, BARRIERS), 6)
    got = sorted((r.year, r.pos, r.result) for r in kept.collect())
    assert got == [(2024, 0, "loss_sl"), (2025, 0, "loss_sl")]


def test_costs_weights_and_timeout(spark):
    kept = spark.createDataFrame(
        [
            ("X", 2024, START, "win", 5.0, 0.44),
            ("X", 2024, START, "loss_sl", 5.0, 0.5),
            ("X", 2024, START, "loss_timeout", 5.0, 0.55),
        ],
        "symbol string, year int, time timestamp_ntz, result string, spread double, proba_max double",
    )
    account = Account(commission=1.25)
    got = {r.result: r for r in trade_pnl(kept, Barriers(), account, weight_step).collect()}
    assert got["win"].gross == 20 - 0.5 - 1.25 and got["win"].net == got["win"].gross * 0.5
    assert got["loss_sl"].gross == -10 - 0.5 - 1.25 and got["loss_sl"].weight == 1.0
    assert got["loss_timeout"].gross == got["loss_sl"].gross
    assert got["loss_timeout"].weight == 1.5


def test_thresholds():
    assert normalise_threshold(0.45) == 0.45
    assert normalise_threshold(45) == 0.45
    assert normalise_threshold(1) == 0.01


def test_signals_need_side_and_confidence(spark):
    rows = [(1, 45.0, 30.0, 25.0), (1, 44.99, 30.0, 25.0), (-1, 50.0, 10.0, 40.0), (-1, 1.0, 2.0, 45.0), (0, 9.0, 90.0, 1.0)]
    df = spark.createDataFrame(rows, "yhat int, conf_up double, conf_flat double, conf_down double")
    df = with_signals(df.withColumn("time", F.lit(START).cast("timestamp_ntz")))
    assert [r.signal for r in df.collect()] == [1, 0, 0, -1, 0]


def test_no_signal_gives_an_empty_table_of_the_fixed_schema(spark):
    signals = with_side(spark, random_walk(50, seed=1), [0] * 50)
    found = non_overlapping_events(first_passage(signals, BARRIERS), 6)
    table = trades_table(trade_pnl(found, BARRIERS))
    assert table.count() == 0
    assert [(f.name, f.dataType) for f in table.schema] == [
        (f.name, f.dataType) for f in TRADE_SCHEMA
    ]


def test_enrich_adds_features_and_renames_percentages(spark):
    trades = spark.createDataFrame([("X", 2024, START, 1.0, 1.0, 1.0, "win")], TRADE_SCHEMA)
    inputs = spark.createDataFrame(
        [("X", START, 2024, 50.0, 30.0, 20.0, 1, 7.5), ("X", START.replace(day=2), 2024, 1.0, 1.0, 1.0, 1, 9.0)],
        "symbol string, time timestamp_ntz, year int, conf_up double, conf_flat double,"
        " conf_down double, signal int, RSI_14 double",
    )
    row = enrich_trades(trades, inputs).collect()
    assert len(row) == 1 and row[0].RSI_14 == 7.5
    assert (row[0].proba_hausse, row[0].proba_neutre, row[0].proba_baisse) == (50.0, 30.0, 20.0)
    assert semi_join_entries(inputs, trades).count() == 1
