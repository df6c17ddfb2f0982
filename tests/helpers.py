"""Small bar series and plain sequential loops to compare with."""

import math
import random
from datetime import datetime, timedelta

from barloom.sources.bar_files import BAR_SCHEMA

START = datetime(2024, 1, 1)


def bars_frame(spark, rows, symbol="X", timeframe="H1"):
    """Bars from (hour offset, high, low, close) rows."""
    data = [
        (symbol, timeframe, START + timedelta(hours=t), float(c), float(h), float(l), float(c), 1.0, 2.0)
        for t, h, l, c in rows
    ]
    return spark.createDataFrame(data, BAR_SCHEMA)


def random_walk(n, seed, step=10, gap=True, flat=0.0):
    """Integer (hour, high, low, close) rows; ``flat`` is the share of bars that do not move."""
    rng = random.Random(seed)
    price, hour, rows = 10_000, 0, []
    for _ in range(n):
        if rng.random() >= flat:
            price += rng.randint(-step, step)
            reach = rng.randint(0, step)
        else:
            reach = 0
        rows.append((hour, price + reach, price - reach, price))
        hour += rng.choice([1, 1, 1, 2, 50]) if gap else 1
    return rows


def loop_labels(rows, tp, sl, window):
    """Long and short scans, the stop tested first on every bar."""
    out = []
    for i in range(len(rows)):
        if i + window >= len(rows):
            out.append(None)
            continue
        entry = rows[i][3]
        won = []
        for side in (1, -1):
            result = False
            for _, high, low, _ in rows[i + 1 : i + window + 1]:
                against = low <= entry - sl if side == 1 else high >= entry + sl
                target = high >= entry + tp if side == 1 else low <= entry - tp
                if against:
                    break
                if target:
                    result = True
                    break
            won.append(result)
        out.append(1 if won == [True, False] else -1 if won == [False, True] else 0)
    return out


def loop_trades(rows, signals, tp, sl, window):
    """(entry position, result, position where the next entry may happen), one trade at a time."""
    out, free = [], 0
    for i, side in enumerate(signals):
        if side == 0 or i < free:
            continue
        entry, result, free = rows[i][3], None, i + window
        for j in range(i + 1, i + window + 1):
            if j >= len(rows):
                result, free = "loss_sl", len(rows)
                break
            _, high, low, _ = rows[j]
            if (low <= entry - sl) if side == 1 else (high >= entry + sl):
                result, free = "loss_sl", j
                break
            if (high >= entry + tp) if side == 1 else (low <= entry - tp):
                result, free = "win", j
                break
        out.append((i, result or "loss_timeout", free))
    return out


def close_enough(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
