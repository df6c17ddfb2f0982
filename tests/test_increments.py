"""History and increments against the whole series."""

import math
from datetime import timedelta

import pytest
from helpers import START, bars_frame, random_walk
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.config import Indicators, Layout
from barloom.operators.increments import add_to_indicators, bars_kept
from barloom.operators.indicators import add_indicators
from barloom.session import stored

COLUMNS = ("Log_Return", "EMA_9", "Dist_EMA_50", "RSI_14", "ADX_14", "ATR_14", "BB_Width", "Hour_Sin")


def parts(bars, hours):
    edges = [START + timedelta(hours=h) for h in (-1, *hours, 10**6)]
    return [bars.where((F.col("time") > F.lit(a)) & (F.col("time") <= F.lit(b))) for a, b in zip(edges, edges[1:])]


def same(found, whole):
    rows = [sorted(df.select("symbol", "time", *COLUMNS).collect(), key=lambda r: (r.symbol, r.time)) for df in (found, whole)]
    assert [(r.symbol, r.time) for r in rows[0]] == [(r.symbol, r.time) for r in rows[1]]
    for a, b in zip(*rows):
        for c in COLUMNS:
            assert (a[c] is None) == (b[c] is None), (c, a, b)
            assert a[c] is None or math.isclose(a[c], b[c], rel_tol=1e-8, abs_tol=1e-8), (c, a, b)


def by_parts(bars, hours, spec=Indicators(), layout=Layout()):
    state, found = None, None
    for part in parts(bars, hours):
        added, state = add_to_indicators(part, COLUMNS, state, spec, layout=layout)
        state = stored(state)
        found = added if found is None else found.unionByName(added)
    return found, state


@pytest.mark.parametrize("start", ["first", "adjusted"])
def test_increments_equal_the_whole(spark, start):
    """Two series, one that begins later and one that pauses; parts of a single bar among them."""
    bars = bars_frame(spark, random_walk(420, seed=1, gap=False)).unionByName(
        bars_frame(spark, [(h + 130, *r) for h, *r in random_walk(250, seed=2, gap=False, flat=0.3)], "Y")
    )
    spec = Indicators(wilder_start=start)
    found, state = by_parts(bars, (100, 101, 230, 395), spec)
    same(found, add_indicators(bars, COLUMNS, spec))
    many, begins = bars_kept(COLUMNS, spec)
    rows = {r.symbol: r for r in state.collect()}
    assert {s: r.pos for s, r in rows.items()} == {"X": 419, "Y": 249}
    assert all(len(r.tail) == many and r._at == r.pos - many + 1 for r in rows.values())


def test_short_series_keep_their_bars(spark):
    bars = bars_frame(spark, random_walk(70, seed=4, gap=False))
    found, state = by_parts(bars, (3, 20, 50, 60))
    same(found, add_indicators(bars, COLUMNS))
    assert state.first()._at is None and len(state.first().tail) == 70


def test_means_that_start_anew(spark):
    """Longer without a move than RSI and ADX outlive, over the end of a part."""
    moving, still = random_walk(60, seed=5, gap=False), 8_200
    price = moving[-1][3]
    rows = moving + [(60 + k, price, price, price) for k in range(still)]
    rows += [(60 + still + h, hi, lo, c) for h, hi, lo, c in random_walk(90, seed=6, gap=False)]
    bars = bars_frame(spark, rows)
    layout = Layout(block_rows=4_096, sub_rows=256)
    found, _ = by_parts(bars, (200, 8_180, 8_300), layout=layout)
    whole = add_indicators(bars, COLUMNS, layout=layout)
    same(found, whole)
    assert whole.where("RSI_14 is null").count() > 50


def test_bars_that_do_not_follow_are_an_error(spark):
    bars = bars_frame(spark, random_walk(120, seed=7, gap=False))
    _, state = add_to_indicators(bars, COLUMNS)
    state = stored(state)
    with pytest.raises(PySparkException, match="does not follow"):
        add_to_indicators(parts(bars, (110,))[1], COLUMNS, state)[0].count()
    with pytest.raises(ValueError):
        add_to_indicators(bars, COLUMNS, spec=Indicators(wilder_start="sma"))
    unchanged = add_to_indicators(bars.limit(0), COLUMNS, state)
    assert unchanged[0].count() == 0
    assert unchanged[1].drop("tail").collect() == state.drop("tail").collect()
