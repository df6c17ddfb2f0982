"""Barriers in long windows against sequential loops, and against the lists of short ones."""

import random

from dataclasses import replace

import numpy as np
import pytest
from helpers import START, bars_frame, loop_labels, loop_trades, random_walk
from pyspark.sql import functions as F

from barloom.config import Barriers, Layout
from barloom.operators.events import first_passage, non_overlapping_events
from barloom.operators.indicators import add_indicators
from barloom.operators.labels import triple_barrier_label
from barloom.operators.touches import frames, untouched


@pytest.mark.parametrize("window", [1, 2, 3, 7, 64, 100, 1440])
def test_descent_finds_the_first_touch(window):
    dealt = np.random.default_rng(window)
    walk = dealt.integers(-6, 7, 900).cumsum().astype(float)
    high, low = np.append(walk + 2, -np.inf), np.append(walk - 2, np.inf)
    at, reach = np.arange(900), dealt.integers(1, 90, 900)
    found = untouched(
        frames(high, window, np.maximum), frames(low, window, np.minimum), at + 1, walk + reach, walk - reach, window
    )
    for i in at:
        ahead = range(i + 1, min(i + window, 899) + 1)
        touch = next((j for j in ahead if high[j] >= walk[i] + reach[i] or low[j] <= walk[i] - reach[i]), None)
        assert found[i] == (window if touch is None else touch - i - 1)


def labels(spark, rows, barriers, layout=Layout()):
    df = triple_barrier_label(bars_frame(spark, rows), barriers, layout=layout)
    return [r.Target for r in df.orderBy("time").collect()]


@pytest.mark.parametrize("layout", [Layout(), Layout(86_400 * 5, 128, 16), Layout(3_600 * 400, 700, 4)])
def test_long_windows_label_as_a_loop(spark, layout):
    rows = random_walk(1500, seed=8)
    expected = loop_labels(rows, 150, 100, 333)
    assert labels(spark, rows, Barriers(150, 100, 333, 1.0), layout) == expected
    assert {1, -1, 0, None} <= set(expected)


def test_both_ways_agree_on_odd_prices(spark):
    bars = bars_frame(spark, random_walk(400, seed=2)).unionByName(bars_frame(spark, random_walk(90, seed=3), "Y"))
    n = F.abs(F.xxhash64("symbol", "time")) % 17
    odd = {c: F.when(n == k, F.lit(None)).when(n == k + 3, F.lit(float("nan"))).otherwise(F.col(c)) for k, c in ((1, "high"), (2, "low"))}
    bars = bars.withColumns(odd)
    for layout in (Layout(), Layout(block_rows=64, sub_rows=16)):
        for barriers in (Barriers(30, 20, 24, 1.0), Barriers(60, 60, 40, 1.0)):
            ways = [
                triple_barrier_label(bars, barriers, layout=replace(layout, list_window=w)).select("symbol", "time", "Target")
                for w in (64, 0)
            ]
            assert sorted(ways[0].collect()) == sorted(ways[1].collect(), key=lambda r: (r.symbol, r.time))


def test_indicators_carry_the_long_label(spark):
    bars = bars_frame(spark, random_walk(600, seed=5))
    barriers = Barriers(90, 60, 120, 1.0)
    both = add_indicators(bars, ("RSI_14", "EMA_9"), label=barriers)
    assert both.columns == [*bars.columns, "Target", "RSI_14", "EMA_9"]
    alone = {r.time: r.Target for r in triple_barrier_label(bars, barriers).collect()}
    assert {r.time: r.Target for r in both.collect()} == alone
    empty = triple_barrier_label(bars.limit(0), barriers)
    assert empty.columns == [*bars.columns, "Target"] and empty.count() == 0


@pytest.mark.parametrize("layout", [Layout(), Layout(86_400 * 5, 128, 16)])
def test_long_trades_end_as_in_a_loop(spark, layout):
    dealt, rows = random.Random(6), random_walk(900, seed=6, gap=False)
    signals = [dealt.choice([0, 0, 1, -1]) for _ in rows]
    hours = {START.replace(tzinfo=None).timestamp() + 3600 * h: s for (h, *_), s in zip(rows, signals)}
    side = spark.createDataFrame([(int(k), s) for k, s in hours.items()], "at long, signal int")
    bars = bars_frame(spark, rows).withColumn("year", F.lit(2024))
    bars = bars.withColumn("at", F.unix_timestamp(F.col("time").cast("timestamp"))).join(side, "at")
    barriers = Barriers(60, 50, 200, 1.0)
    found = first_passage(bars, barriers, layout=layout)
    expected = loop_trades(rows, signals, 60, 50, 200)
    kept = non_overlapping_events(found, barriers.window).orderBy("pos").collect()
    assert [(r.pos, r.result, r.free_at) for r in kept] == expected
    assert {"win", "loss_sl"} <= {e[1] for e in expected}
