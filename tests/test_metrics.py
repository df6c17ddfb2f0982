import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import START, close_enough
from pyspark.sql import functions as F

from barloom.config import Account, Barriers
from barloom.operators import losses, metrics, sizing
from barloom.operators.events import TRADE_SCHEMA

BARRIERS = Barriers(20, 10, 24, 1.0)


def trades(spark, nets, hours=None, symbol="X", gross=None):
    hours = hours or [24 * i for i in range(len(nets))]
    gross = gross or nets
    data = [
        (symbol, 2024, START + timedelta(hours=h), float(n), float(g), 1.0, "win" if g > 0 else "loss_sl")
        for n, g, h in zip(nets, gross, hours)
    ]
    return spark.createDataFrame(data, TRADE_SCHEMA)


def inputs(spark, closes, symbol="X"):
    data = [(symbol, 2024, START + timedelta(hours=i), c, 1) for i, c in enumerate(closes)]
    return spark.createDataFrame(data, "symbol string, year int, time timestamp_ntz, close double, signal int")


def test_drawdown_starts_at_the_first_trade(spark):
    assert metrics.max_drawdown(trades(spark, [-5, 3, -1])).first().dd == -1.0
    assert metrics.max_drawdown(trades(spark, [-5, -5])).first().dd == -5.0


def test_equity_over_several_days(spark):
    rows = metrics.equity_curve(trades(spark, [5, -2, 4, -9], [0, 1, 30, 90])).orderBy("time").collect()
    assert [(r.equity, r.peak, r.drawdown) for r in rows] == [(5, 5, 0), (3, 5, -2), (7, 7, 0), (-2, 7, -9)]


def test_daily_sums_fill_empty_days(spark):
    rows = metrics.daily_pnl(trades(spark, [5, -2, 4], [0, 1, 72])).orderBy("day").collect()
    assert [r.pnl for r in rows] == [3.0, 0.0, 0.0, 4.0]


def test_sharpe_of_one_day_and_of_equal_days_is_zero(spark):
    assert metrics.sharpe(trades(spark, [5, -2], [0, 1])).first().sharpe == 0.0
    assert metrics.sharpe(trades(spark, [5, 5, 5])).first().sharpe == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_all_metrics_against_pandas(spark, seed):
    rng = random.Random(seed)
    hours = sorted(rng.sample(range(24 * 200), 150))
    nets = [rng.choice([20, -10, -10, 20, 5]) * rng.choice([0.8, 1.2, 1.0]) for _ in hours]
    closes = [float(rng.randint(90, 110)) for _ in range(50)]
    row = metrics.metrics_record(trades(spark, nets, hours), inputs(spark, closes), BARRIERS, Account()).first()
    s = pd.Series(nets, index=[START + timedelta(hours=h) for h in hours])
    total, curve, daily = s.sum(), s.cumsum(), s.resample("D").sum()
    dd, hold = (curve - curve.cummax()).min(), closes[-1] - closes[0]
    want = {
        "trades": len(s),
        "profit_net": total,
        "dd": dd,
        "win_rate": (s > 0).mean() * 100,
        "sharpe": daily.mean() / daily.std() * np.sqrt(252),
        "pips_sharpe": daily.mean() / daily.std() * np.sqrt(252),
        "total_return_pct": total / 100,
        "max_dd_pct": dd / 100,
        "bh_pips": hold,
        "bh_return_pct": hold / 100,
        "alpha_pips": total - hold,
        "alpha_return_pct": total / 100 - hold / 100,
    }
    for name, value in want.items():
        assert close_enough(float(row[name]), float(value)), name
    assert row.n_signals == 50


def test_no_trades_means_zeros_for_buy_and_hold_too(spark):
    rows = inputs(spark, [100.0, 150.0])
    record = metrics.with_ratios(metrics.metrics_record(trades(spark, [1]).limit(0), rows, BARRIERS)).first()
    assert record.n_signals == 2 and record.trades == 0
    assert all(record[c] == 0.0 for c in (*metrics.METRICS, "expectancy", "signal_ratio"))


def test_buy_and_hold_skips_missing_closes(spark):
    assert metrics.buy_and_hold(inputs(spark, [None, 100.0, 130.0, None]), BARRIERS).first().bh_pips == 30.0
    assert metrics.buy_and_hold(inputs(spark, [None, 100.0]), BARRIERS).first().bh_pips == 0.0


def test_costs_can_turn_a_reached_target_into_a_loss(spark):
    assert metrics.win_rate_profit(trades(spark, [-0.5, 4], gross=[-0.5, 4])).first().win_rate == 50.0


def test_summary_has_a_total_per_symbol(spark):
    both = trades(spark, [1, 2]).unionByName(trades(spark, [5], symbol="Y"))
    rows = inputs(spark, [1.0, 2.0]).unionByName(inputs(spark, [1.0, 2.0], symbol="Y"))
    summary = metrics.yearly_summary(metrics.metrics_record(both, rows, BARRIERS)).collect()
    totals = {(r.symbol, r.year): r.profit_net for r in summary}
    assert totals == {("X", 2024): 3, ("X", None): 3, ("Y", 2024): 5, ("Y", None): 5, (None, None): 8}


def test_zero_net_is_neither_won_nor_lost(spark):
    row = losses.loss_breakdown(trades(spark, [0, 5, -5, 0])).first()
    assert (row.trades, row.losses, row.win_pct, row.losses_stop) == (4, 1, 25.0, 1)


def test_gap_ties_keep_column_order(spark):
    df = trades(spark, [1, -1]).withColumns(
        {c: F.when(F.col("net") > 0, F.lit(v)).otherwise(F.lit(0.0)) for c, v in (("a", 1.0), ("b", 3.0), ("c", 1.0))}
    )
    rows = losses.mean_gap_top(df, ["a", "b", "c"], top=2).orderBy("rank").collect()
    assert [(r.feature, r.gap) for r in rows] == [("b", 3.0), ("a", 1.0)]


def test_box_numbers(spark):
    values = [10.0, 40.0, 41.0, 42.0, 43.0, 44.0, 90.0]
    df = spark.createDataFrame([("win", v, 1.0, 1.0) for v in values], "result string, proba_hausse double, proba_neutre double, proba_baisse double")
    row = losses.box_stats(df).first()
    assert (row.trades, row.q1, row.median, row.q3) == (7, 40.5, 42.0, 43.5)
    assert (row.whisker_low, row.whisker_high, row.outliers) == (40.0, 44.0, 2)


def priced(spark, nets, symbol="X"):
    return trades(spark, nets, symbol=symbol).withColumn("proba_max", F.lit(0.7)).drop("weight", "net")


def test_sweep_prices_every_candidate_and_ties_go_to_the_first(spark):
    rows = inputs(spark, [1.0, 2.0])
    same = {"one": lambda p: F.lit(1.0), "two": lambda p: F.lit(1.0), "low": lambda p: F.lit(0.5)}
    swept = sizing.sizing_sweep(priced(spark, [20, -10]), rows, BARRIERS, candidates=same)
    assert {r.candidate: r.profit_net for r in swept.collect()} == {"one": 10.0, "two": 10.0, "low": 5.0}
    best = sizing.best_candidate(swept)
    assert best.first().candidate == "one"
    confirmed = sizing.confirm_on_test(best, priced(spark, [7]), rows, BARRIERS, candidates=same).collect()
    assert [(r.candidate, r.profit_net) for r in confirmed] == [("one", 7.0)]


def test_sweep_without_trades_keeps_its_rows(spark):
    swept = sizing.sizing_sweep(priced(spark, [1]).limit(0), inputs(spark, [1.0, 2.0]), BARRIERS)
    assert swept.count() == 4 and sizing.best_candidate(swept).first().candidate == "linear_0.5-1.5"
