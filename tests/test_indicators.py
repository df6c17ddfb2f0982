import numpy as np
import pandas as pd
import pytest
from helpers import bars_frame, close_enough, random_walk

from barloom.config import Indicators, Layout
from barloom.operators.indicators import add_indicators, base_features, log_returns
from barloom.operators.labels import triple_barrier_label
from barloom.operators.series import with_position

COLUMNS = ["Log_Return", "EMA_9", "Dist_EMA_50", "RSI_14", "ATR_14", "ADX_14", "BB_Width"]


def loop_ema(x, n):
    out, y = [None] * len(x), None
    for i, v in enumerate(x):
        if i == n - 1:
            y = sum(x[:n]) / n
        elif i >= n:
            y += (v - y) * 2 / (n + 1)
        out[i] = y
    return out


def loop_wilder(x, n=14, start="first"):
    """A value that is missing again later ends the mean, and the next one starts another."""
    out, y, seen, weight = [], None, [], 0.0
    for v in x:
        if v is None:
            out.append(None)
            y, weight = None, 0.0
            continue
        seen.append(v)
        if start == "first":
            y = v if y is None else y + (v - y) / n
        elif start == "adjusted":
            weight = 1.0 + weight * (1 - 1 / n)
            y = v if y is None else y + (v - y) / weight
        elif len(seen) == n:
            y = sum(seen) / n
        elif len(seen) > n:
            y += (v - y) / n
        out.append(y)
    return out


def loop_ratio(up, down, ups, downs, limit=8_096):
    """100 * up / (up + down) of two means, given up once nothing moved for more than ``limit`` bars.

    The means decay alike while nothing moves, so the ratio is held instead of being taken from
    numbers that run out of digits.
    """
    out, move, held = [], None, None
    for i, (a, b) in enumerate(zip(up, down)):
        moves = (ups[i] or 0) > 0 or (downs[i] or 0) > 0
        if moves:
            move = i
        if a is not None and a + b > 0 and (moves or held is None):
            held = (a / (a + b), b / (a + b))
        out.append(held if move is not None and i - move <= limit else None)
    return out


def expected(rows, start="first", first_range="null", sd="population"):
    high, low, close = ([float(r[k]) for r in rows] for k in (1, 2, 3))
    n = len(rows)
    change = [None] + [close[i] - close[i - 1] for i in range(1, n)]
    gains = [None if c is None else max(c, 0.0) for c in change]
    losses = [None if c is None else max(-c, 0.0) for c in change]
    gain, loss = loop_wilder(gains, start=start), loop_wilder(losses, start=start)
    rsi = [r and 100 * r[0] for r in loop_ratio(gain, loss, gains, losses)]
    rng = [high[0] - low[0] if first_range == "high_low" else None]
    plus, minus = [None], [None]
    for i in range(1, n):
        rng.append(max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])))
        up, down = high[i] - high[i - 1], low[i - 1] - low[i]
        plus.append(up if up > down and up > 0 else 0.0)
        minus.append(down if down > up and down > 0 else 0.0)
    early = [r for r in rng[:14] if r is not None]
    atr, y = [], None
    for i, r in enumerate(rng):
        if i == 13:
            y = sum(early) / len(early)
        elif i > 13:
            y += (r - y) / 14
        atr.append(y)
    p, m = loop_wilder(plus, start=start), loop_wilder(minus, start=start)
    shares = loop_ratio(p, m, plus, minus)
    dx = [None if i < 13 or s is None else 100 * abs(s[0] - s[1]) for i, s in enumerate(shares)]
    c = pd.Series(close)
    ddof = 0 if sd == "population" else 1
    width = 4 * c.rolling(20).std(ddof=ddof) / c.rolling(20).mean()
    ema50 = loop_ema(close, 50)
    return {
        "Log_Return": [None] + [float(np.log(close[i] / close[i - 1])) for i in range(1, n)],
        "EMA_9": loop_ema(close, 9),
        "Dist_EMA_50": [None if e is None else (x - e) / x for x, e in zip(close, ema50)],
        "RSI_14": rsi,
        "ATR_14": atr,
        "ADX_14": loop_wilder(dx, start=start),
        "BB_Width": [None if np.isnan(w) else float(w) for w in width],
    }


def check(spark, rows, spec=Indicators(), layout=Layout(), **options):
    df = add_indicators(bars_frame(spark, rows), COLUMNS, spec, layout=layout).orderBy("time")
    got, want = df.collect(), expected(rows, **options)
    assert len(got) == len(rows)
    for column in COLUMNS:
        for i, row in enumerate(got):
            assert close_enough(row[column], want[column][i]), (column, i, row[column], want[column][i])


def test_defaults(spark):
    check(spark, random_walk(400, seed=5))


def test_many_small_blocks(spark):
    check(spark, random_walk(900, seed=6), layout=Layout(3_600 * 40, 256, 128))


def test_long_pause_keeps_ratios(spark):
    """A flat stretch longer than several pieces must not lose the averages before it."""
    rows = random_walk(100, seed=8, gap=False)
    last = rows[-1]
    rows += [(100 + i, last[3], last[3], last[3]) for i in range(900)]
    rows += [(1_000 + h, *bar) for h, *bar in random_walk(60, seed=9, gap=False)]
    check(spark, rows, layout=Layout(3_600 * 100, 512, 128))


def test_flat_start_has_no_rsi_until_the_first_move(spark):
    rows = [(i, 100, 100, 100) for i in range(30)] + [(30, 105, 99, 104), (31, 104, 101, 102)]
    check(spark, rows)


@pytest.mark.parametrize("start", ["adjusted", "sma"])
def test_other_starts(spark, start):
    rows = random_walk(300, seed=11)
    check(spark, rows, Indicators(wilder_start=start), start=start)
    check(spark, rows, Indicators(wilder_start=start), Layout(3_600 * 30, 256, 128), start=start)


def test_other_conventions(spark):
    rows = random_walk(120, seed=12)
    spec = Indicators(first_range="high_low", bollinger_sd="sample")
    check(spark, rows, spec, first_range="high_low", sd="sample")


def test_series_shorter_than_every_length(spark):
    got = add_indicators(bars_frame(spark, random_walk(5, seed=1)), COLUMNS).collect()
    assert all(r.EMA_9 is None and r.ATR_14 is None and r.BB_Width is None for r in got)


def test_series_do_not_mix(spark):
    a, b = random_walk(80, seed=1), random_walk(80, seed=2)
    both = bars_frame(spark, a).unionByName(bars_frame(spark, b, symbol="Y"))
    got = add_indicators(both, ["EMA_9"]).where("symbol = 'Y'").orderBy("time").collect()
    want = loop_ema([float(r[3]) for r in b], 9)
    assert all(close_enough(r.EMA_9, w) for r, w in zip(got, want))


def test_zero_close_gives_null_not_an_error(spark):
    rows = [(0, 1, 0, 1), (1, 1, 0, 0), (2, 1, 0, 1)]
    assert [r.Log_Return for r in log_returns(bars_frame(spark, rows)).orderBy("time").collect()] == [
        None,
        None,
        None,
    ]


def test_base_features_carry_the_suffix(spark):
    df = base_features(bars_frame(spark, random_walk(60, seed=3)), "_H4")
    assert df.columns[3:] == ["RSI_14_H4", "Dist_EMA_20_H4", "Dist_EMA_50_H4"]


@pytest.mark.parametrize("last", [49, 1_000, 2_040, 2_047, 2_048])
def test_a_flat_series_gives_the_same_in_every_layout(spark, last):
    """The last move may fall anywhere into a piece; then nothing, then moves again."""
    rows = random_walk(last + 1, seed=last, gap=False)
    final = rows[-1][3] + 3
    rows[-1] = (last, final + 2, final - 1, final)
    rows += [(last + 1 + i, final, final, final) for i in range(8_110)]
    rows += [(len(rows) + h, *bar) for h, *bar in random_walk(40, seed=1, gap=False)]
    wanted = ["RSI_14", "ADX_14", "EMA_9", "ATR_14"]
    want = expected(rows)
    for layout in (Layout(), Layout(block_rows=4_096), Layout(block_rows=1_024, sub_rows=256)):
        got = add_indicators(bars_frame(spark, rows), wanted, layout=layout).orderBy("time").collect()
        for column in wanted:
            for i, row in enumerate(got):
                assert close_enough(row[column], want[column][i], 1e-8), (layout, column, i, row[column], want[column][i])
    assert want["RSI_14"][last + 8_096] is not None and want["RSI_14"][last + 8_097] is None


def test_a_cut_series_is_numbered_anew(spark):
    rows = random_walk(400, seed=3)
    stored = with_position(bars_frame(spark, rows), ["symbol", "timeframe"])
    for cut in ("pos >= 100", "time >= '2024-02-01'", "pos < 100 or pos > 140"):
        left = stored.where(cut)
        places = sorted(r.pos for r in left.collect())
        want = expected([rows[p] for p in places])
        got = add_indicators(left, COLUMNS).orderBy("time").collect()
        for column in COLUMNS:
            assert all(close_enough(r[column], w) for r, w in zip(got, want[column])), (cut, column)
        for step in (
            lambda df: add_indicators(df, COLUMNS, positions="given"),
            lambda df: log_returns(df, positions="given"),
            lambda df: triple_barrier_label(df, positions="given"),
        ):
            with pytest.raises(Exception, match="cut"):
                step(left).collect()
    whole = add_indicators(stored.where("pos < 300"), COLUMNS, positions="given").orderBy("time").collect()
    assert close_enough(whole[-1].RSI_14, expected(rows[:300])["RSI_14"][-1])
