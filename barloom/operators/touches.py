"""First touch of a barrier in long windows, in the logarithm of the window per bar.

For windows of a few dozen bars a list of the bars ahead is enough (``labels.bars_ahead``). Longer
ones are searched by frames of doubling length: the highest high and the lowest low of the next 1,
2, 4, ... bars are kept for every bar, and a descent from the longest frame to the shortest skips
whatever stays inside both barriers. Looking up a frame at a place that differs from row to row is
what window functions cannot do, so a block's rows are searched as arrays; blocks are bounded by the
layout however long a series is.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.config import Barriers
from barloom.operators.series import Blocks
from barloom.session import importable

SIDES = {"long": 1, "short": -1}


def frames(values: np.ndarray, window: int, widest: np.ufunc) -> list[np.ndarray]:
    """Extremes of the 1, 2, 4, ... values from each place on, up to the window. The last value of
    every frame stands for what lies beyond the end."""
    out, width = [values], 1
    places, last = np.arange(len(values)), len(values) - 1
    while 2 * width <= window:
        out.append(widest(out[-1], out[-1][np.minimum(places + width, last)]))
        width *= 2
    return out


def untouched(
    highs: list[np.ndarray], lows: list[np.ndarray], start: np.ndarray, upper: np.ndarray, lower: np.ndarray, window: int
) -> np.ndarray:
    """How many bars from ``start`` on stay below ``upper`` and above ``lower``, ``window`` at most."""
    skipped = np.zeros(len(start), dtype=np.int64)
    last = len(highs[0]) - 1
    for level in range(len(highs) - 1, -1, -1):
        place = np.minimum(start + skipped, last)
        inside = ~(highs[level][place] >= upper) & ~(lows[level][place] <= lower)
        skipped += np.where(inside & (skipped + 2**level <= window), 2**level, 0)
    return skipped


def prices(column: pa.ChunkedArray, missing: float) -> np.ndarray:
    """Values with one more at the end that touches nothing. A missing price touches nothing; what
    is no number counts as the largest, as in comparisons of the engine."""
    values = column.to_numpy().astype(np.float64)
    out = np.where(np.isnan(values), np.inf, values)
    out[column.is_null().to_numpy()] = missing
    return np.append(out, missing)


def first_touches(df: DataFrame, blocks: Blocks, barriers: Barriers, sides: Iterable[str], wanted: str | None = None) -> DataFrame:
    """The rows that each block owns, those where column ``wanted`` is not 0 if it is given, with
    ``_seen``, the bars ahead up to the window, and per side the position of the first bar that
    touches a barrier (``_touch_long``) and whether it leaves the stop alone (``_won_long``)."""
    sides, size, window = tuple(sides), blocks.layout.block_rows, barriers.window
    target, stop = barriers.target_distance, barriers.stop_distance
    fields = [T.StructField("_seen", T.IntegerType())]
    for side in sides:
        fields += [T.StructField(f"_touch_{side}", T.LongType()), T.StructField(f"_won_{side}", T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *fields])

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        pos = rows["pos"].to_numpy()
        own = rows["_block"].to_numpy() == pos // size
        if wanted:
            own &= np.nan_to_num(rows[wanted].to_numpy()) != 0
        at = np.flatnonzero(own)
        high, low = prices(rows["high"], -np.inf), prices(rows["low"], np.inf)
        # A bar without that price leaves no stop alone.
        own_high, own_low = prices(rows["high"], np.inf), prices(rows["low"], -np.inf)
        entry = rows["close"].to_numpy().astype(np.float64)[at]
        highs, lows = frames(high, window, np.maximum), frames(low, window, np.minimum)
        out = rows.take(pa.array(at))
        seen = np.minimum(len(pos) - 1 - at, window)
        out = out.append_column("_seen", pa.array(seen, pa.int32()))
        for side in sides:
            above, below = (target, stop) if SIDES[side] > 0 else (stop, target)
            free = untouched(highs, lows, at + 1, entry + above, entry - below, window)
            touched = free < seen
            bar = np.where(touched, at + 1 + free, len(pos))
            clear = own_low[bar] > entry - stop if SIDES[side] > 0 else own_high[bar] < entry + stop
            place = pa.array(np.append(pos, -1)[bar], pa.int64(), mask=~touched)
            out = out.append_column(f"_touch_{side}", place)
            out = out.append_column(f"_won_{side}", pa.array(touched & clear))
        return out

    importable(df.sparkSession)
    return df.groupBy(*blocks.keys, "_block").applyInArrow(search, schema)
