import random
from datetime import timedelta

import pandas as pd
import pytest
from helpers import START

from barloom.config import Layout
from barloom.operators.asof import RightSide, asof_backward, asof_by_time

LEFT = "symbol string, time timestamp_ntz, a int"
RIGHT = "symbol string, time timestamp_ntz, v int"


def at(hours):
    return START + timedelta(hours=hours)


def match(spark, left, right, layout=Layout(), lag=0.0):
    l = spark.createDataFrame([("X", at(t), t) for t in left], LEFT)
    r = spark.createDataFrame([("X", at(t), v) for t, v in right], RIGHT)
    df = asof_backward(l, [RightSide(r, ("v",), lag)], ["symbol"], layout)
    return {row.a: row.v for row in df.collect()}


def test_exact_earlier_and_none(spark):
    assert match(spark, [0, 5, 6, 9], [(5, 50), (8, 80)]) == {0: None, 5: 50, 6: 50, 9: 80}


def test_a_null_value_still_matches(spark):
    assert match(spark, [9], [(5, 50), (8, None)]) == {9: None}


def test_match_from_a_much_earlier_slice(spark):
    layout = Layout(slice_seconds=3_600)
    assert match(spark, [2_000, 2_001], [(3, 30)], layout) == {2_000: 30, 2_001: 30}


def test_lag_hides_bars_that_have_not_closed(spark):
    assert match(spark, [4, 7, 8], [(0, 1), (4, 2)], lag=4.0) == {4: 1, 7: 1, 8: 2}


def test_keys_do_not_mix(spark):
    l = spark.createDataFrame([("X", at(5), 1), ("Y", at(5), 2)], LEFT)
    r = spark.createDataFrame([("X", at(1), 10)], RIGHT)
    got = {row.symbol: row.v for row in asof_backward(l, [RightSide(r, ("v",))], ["symbol"]).collect()}
    assert got == {"X": 10, "Y": None}


@pytest.mark.parametrize("slice_hours", [5, 50, 10_000])
def test_same_as_a_merge_per_symbol(spark, slice_hours):
    rng = random.Random(slice_hours)
    layout = Layout(slice_seconds=slice_hours * 3_600)
    left, sides = [], [[], []]
    for symbol in "XYZ":
        left += [(symbol, t) for t in sorted(rng.sample(range(900), 120))]
        for n, side in enumerate(sides):
            side += [(symbol, t, t * 10 + n) for t in sorted(rng.sample(range(900), 25))]
    l = spark.createDataFrame([(s, at(t), t) for s, t in left], LEFT)
    rights = [
        RightSide(spark.createDataFrame([(s, at(t), v) for s, t, v in side], f"symbol string, time timestamp_ntz, v{n} int"), (f"v{n}",))
        for n, side in enumerate(sides)
    ]
    got = {(r.symbol, r.a): (r.v0, r.v1) for r in asof_backward(l, rights, ["symbol"], layout).collect()}
    frame = pd.DataFrame(left, columns=["s", "t"]).sort_values("t")
    want = frame
    for n, side in enumerate(sides):
        right = pd.DataFrame(side, columns=["s", "t", f"v{n}"]).sort_values("t")
        want = pd.merge_asof(want, right, on="t", by="s")
    assert len(got) == len(want)
    for row in want.itertuples():
        pair = tuple(None if pd.isna(v) else int(v) for v in (row.v0, row.v1))
        assert got[(row.s, row.t)] == pair


def test_by_time_serves_every_symbol(spark):
    l = spark.createDataFrame([("X", at(5), 1), ("Y", at(5), 2), ("Y", at(0), 3)], LEFT)
    r = spark.createDataFrame([("G", at(1), 10), ("G", at(6), 60)], RIGHT).drop("symbol")
    got = {row.a: row.v for row in asof_by_time(l, [RightSide(r, ("v",))]).collect()}
    assert got == {1: 10, 2: 10, 3: None}
