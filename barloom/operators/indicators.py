"""Technical indicators of bar series.

Everything one series needs is computed in one pass over its blocks: one shuffle, one sort, and
window operators on top. The exponential means are sums of decaying weights (``decaying_sums``),
so no step walks a series row by row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import Barriers, Indicators, Layout
from barloom.operators.labels import add_target, triple_barrier_label
from barloom.operators.series import (
    RATIO_TAIL,
    TAIL,
    Blocks,
    Decay,
    decaying_sums,
    layout_for,
    ratio_rows,
    with_position,
)


@dataclass
class Pass:
    """One round of decaying sums: inputs to prepare, sums to solve, columns to read off.

    Inputs and results are SQL text by column name.
    """

    inputs: dict[str, str] = field(default_factory=dict)
    scans: dict[str, Decay] = field(default_factory=dict)
    results: dict[str, str] = field(default_factory=dict)
    gaps: dict[str, str] = field(default_factory=dict)

    @property
    def kept(self) -> dict[str, str]:
        """What later bars need of each sum: the sum, from the last gap on where it starts anew."""
        return {f"_k{name}": self.gaps.get(name, name) for name in self.scans}


def wilder_factor(length: int) -> float:
    return 1.0 - 1.0 / length


def ema_factor(length: int) -> float:
    return 1.0 - 2.0 / (length + 1.0)


def texts(columns: dict[str, str]) -> dict[str, Column]:
    return {name: F.expr(text) for name, text in columns.items()}


def _add_ema(step: Pass, blocks: Blocks, length: int) -> None:
    """Exponential mean of close that starts with the plain mean of the first n closes."""
    factor = ema_factor(length)
    start = f"sum(case when pos < {length} then close end) {blocks.up_to_now} / {length}"
    step.inputs[f"_z_ema_{length}"] = (
        f"case when pos < {length - 1} then 0D when pos = {length - 1} then {start}"
        f" else close * {1.0 - factor!r}D end"
    )
    step.scans[f"_y_ema_{length}"] = Decay(f"_z_ema_{length}", factor)
    step.results[f"_ema_{length}"] = f"case when pos >= {length - 1} then _y_ema_{length} end"


def first_value(x: str, blocks: Blocks) -> str:
    """SQL text: a row with a value whose row before has none.

    The first row that a block holds is no start unless the series starts there.
    """
    return (
        f"({x} is not null and lag({x}) {blocks.over()} is null"
        f" and (pos = 0 or lag(pos) {blocks.over()} is not null))"
    )


def since_gap(y: str, x: str, factor: float, blocks: Blocks) -> str:
    """SQL text: the decaying sum ``y`` without what came before the last row where ``x`` is NULL."""
    gap = f"last(case when {x} is null then {{}} end, true) {blocks.up_to_now}"
    old = f"pow({factor!r}D, pos - {gap.format('pos')}) * {gap.format(y)}"
    return f"({y} - coalesce({old}, 0D))"


def _add_wilder(
    step: Pass,
    blocks: Blocks,
    x: str,
    length: int,
    start: str,
    tail: float,
    begins: str,
    gaps: bool = False,
) -> None:
    """Wilder mean of column ``x``, which has values from the row on where ``begins`` holds.

    With ``gaps`` it may lose and regain its values, and the mean then starts anew.
    """
    factor = wilder_factor(length)
    mean, ready = f"_yw{x}", f"{x} is not null"
    if gaps:
        mean = since_gap(mean, x, factor, blocks)
        step.gaps[f"_yw{x}"] = mean
    known, share = f"coalesce({x}, 0D)", f"{1.0 - factor!r}D"
    if start == "first":
        step.inputs[f"_zw{x}"] = f"case when {begins} then {x} else {known} * {share} end"
    elif start == "adjusted":
        step.inputs[f"_zw{x}"] = known
        step.inputs[f"_zn{x}"] = f"cast({x} is not null as double)"
        step.scans[f"_yn{x}"] = Decay(f"_zn{x}", factor, tail)
        shares = since_gap(f"_yn{x}", x, factor, blocks) if gaps else f"_yn{x}"
        step.gaps[f"_yn{x}"] = shares
        mean = f"try_divide({mean}, {shares})"
    elif start == "sma":
        seen = f"count({x}) {blocks.up_to_now}"
        step.inputs[f"_zn{x}"] = (
            f"case when {blocks.starts_series} then {seen} else {length + 1} end"
        )
        step.inputs[f"_zw{x}"] = (
            f"case when {x} is null or ({blocks.starts_series} and {seen} < {length}) then 0D"
            f" when {blocks.starts_series} and {seen} = {length}"
            f" then sum({x}) {blocks.up_to_now} / {length} else {known} * {share} end"
        )
        ready = f"_zn{x} >= {length}"
    else:
        raise ValueError(f"unknown wilder_start: {start}")
    step.scans[f"_yw{x}"] = Decay(f"_zw{x}", factor, tail)
    step.results[f"_w{x}"] = f"case when {ready} then {mean} end"


def _add_range_mean(step: Pass, blocks: Blocks, length: int) -> None:
    """Wilder mean of the true range, started with the mean of the ranges of the first n bars."""
    factor = wilder_factor(length)
    start = f"avg(case when pos < {length} then _range end) {blocks.up_to_now}"
    step.inputs["_z_atr"] = (
        f"case when pos < {length - 1} then 0D when pos = {length - 1} then {start}"
        f" else coalesce(_range, 0D) * {1.0 - factor!r}D end"
    )
    step.scans["_y_atr"] = Decay("_z_atr", factor)
    step.results["_atr"] = f"case when pos >= {length - 1} then _y_atr end"


def _solve(df: DataFrame, blocks: Blocks, step: Pass, carried: bool = False, keep: bool = False) -> DataFrame:
    """Solve the sums of a pass. Rows ``carried`` over know the sums up to row ``_at`` (``_c`` and the
    name of the scan), from which they go on. With ``keep`` the sums stay, from the last gap on."""
    if not step.scans:
        return df
    inputs = step.inputs
    if carried:
        inputs = {n: f"case when pos = _at then 0D else {text} end" for n, text in inputs.items()}
    df = decaying_sums(df.withColumns(texts(inputs)), blocks, step.scans)
    if carried:
        since = "cast(pos - _at as double)"
        df = df.withColumns(
            texts({n: f"{n} + coalesce(pow({x.factor!r}D, {since}) * _c{n}, 0D)" for n, x in step.scans.items()})
        )
    df = df.withColumns(texts(step.results | (step.kept if keep else {})))
    return df.drop(*step.inputs, *step.scans)


def _changes(df: DataFrame, blocks: Blocks, spec: Indicators) -> DataFrame:
    """Differences to the bar before, NULL only on the first bar of a series.

    A copied row at the very edge of a block has no row before it and counts as no change; its
    weight is nil for the rows the block owns.
    """
    df = df.withColumns(texts({f"_p{c}": f"lag({c}) {blocks.over()}" for c in ("close", "high", "low")}))
    first_range = "high - low" if spec.first_range == "high_low" else "null"
    up, down = "high - _phigh", "_plow - low"

    def later(value: str) -> str:
        return f"case when pos > 0 then coalesce({value}, 0D) end"

    return df.withColumns(
        texts(
            {
                "_gain": later("greatest(close - _pclose, 0D)"),
                "_loss": later("greatest(_pclose - close, 0D)"),
                "_range": "case when pos > 0 then greatest(abs(high - low), abs(high - _pclose),"
                f" abs(low - _pclose)) else {first_range} end",
                "_plus": later(f"case when {up} > {down} and {up} > 0 then {up} else 0D end"),
                "_minus": later(f"case when {down} > {up} and {down} > 0 then {down} else 0D end"),
            }
        )
    )


LOG_RETURN = "ln(try_divide(close, {before}))"
TURN = f"hour(time) * {2.0 * math.pi / 24.0!r}D"


def wanted(columns: Sequence[str], spec: Indicators) -> tuple[list[int], bool, bool, bool]:
    """Lengths of the EMAs, and whether RSI, ATR and ADX are among the columns."""
    emas = sorted({int(c.rsplit("_", 1)[1]) for c in columns if "EMA_" in c})
    want_atr = "ATR_Norm" in columns or f"ATR_{spec.atr}" in columns
    return emas, f"RSI_{spec.rsi}" in columns, want_atr, f"ADX_{spec.adx}" in columns


def indicator_blocks(
    columns: Sequence[str], spec: Indicators, keys: Sequence[str], layout: Layout, ahead: int = 0
) -> Blocks:
    """Blocks that reach back as far as the columns look."""
    emas, want_rsi, want_atr, want_adx = wanted(columns, spec)
    factors = [ema_factor(n) for n in emas]
    factors += [wilder_factor(n) for n in (spec.rsi, spec.atr, spec.adx)]
    layout = layout_for(layout, factors)

    # Rows a block must see before its own: whole pieces that still carry weight, plus the one
    # that holds the bar before the first of them.
    def span(factor: float, tail: float) -> int:
        return Decay("", factor, tail).pieces(layout) * layout.sub_rows

    reach = [span(ema_factor(n), TAIL) for n in emas]
    if want_rsi:
        reach.append(span(wilder_factor(spec.rsi), RATIO_TAIL))
    if want_atr or want_adx:
        reach.append(span(wilder_factor(spec.atr), TAIL))
    if want_adx:
        f = wilder_factor(spec.adx)
        reach.append(span(f, RATIO_TAIL) + span(f, TAIL))
    back = max(reach + [spec.bollinger]) + 1
    return Blocks(tuple(keys), back, ahead, layout)


def indicator_columns(
    df: DataFrame, blocks: Blocks, columns: Sequence[str], spec: Indicators, carried: bool = False, keep: bool = False
) -> DataFrame:
    """Add the columns to rows spread over blocks; ``carried`` and ``keep`` as in ``_solve``."""
    emas, want_rsi, want_atr, want_adx = wanted(columns, spec)
    df = _changes(df, blocks, spec)

    def last_move(up: str, down: str, before: str) -> str:
        own = f"max(case when {up} > 0 or {down} > 0 then pos end) {blocks.up_to_now}"
        return f"coalesce({own}, {before})" if carried else own

    moves = {}
    if want_rsi:
        moves["_rsi_move"] = last_move("_gain", "_loss", "_c_rsi_move")
    if want_adx:
        moves["_adx_move"] = last_move("_plus", "_minus", "_c_adx_move")
    df = df.withColumns(texts(moves))

    first, second = Pass(), Pass()
    for n in emas:
        _add_ema(first, blocks, n)
    if want_rsi:
        for value in ("_gain", "_loss"):
            _add_wilder(first, blocks, value, spec.rsi, spec.wilder_start, RATIO_TAIL, "pos = 1")
    if want_atr:
        _add_range_mean(first, blocks, spec.atr)
    if want_adx:
        for value in ("_plus", "_minus"):
            _add_wilder(first, blocks, value, spec.adx, spec.wilder_start, RATIO_TAIL, "pos = 1")
    df = _solve(df, blocks, first, carried, keep)
    if want_adx:
        # Both direction lines are 100 * mean / ATR, so the ATR cancels and only says from which
        # bar on they exist.
        strength = "try_divide(100D * abs(_w_plus - _w_minus), _w_plus + _w_minus)"
        moving = f"pos - _adx_move <= {ratio_rows(wilder_factor(spec.adx))}"
        df = df.withColumn("_dx", F.expr(f"case when pos >= {spec.adx - 1} and {moving} then {strength} end"))
        begins = first_value("_dx", blocks)
        _add_wilder(second, blocks, "_dx", spec.adx, spec.wilder_start, TAIL, begins, gaps=True)
        df = _solve(df, blocks, second, carried, keep)

    trailing = blocks.over(f"rows between {spec.bollinger - 1} preceding and current row")
    deviation = "stddev_pop" if spec.bollinger_sd == "population" else "stddev_samp"
    width = (
        f"try_divide({deviation}(close) {trailing} * {2.0 * spec.bollinger_width!r}D,"
        f" avg(close) {trailing})"
    )
    known = {
        "Log_Return": LOG_RETURN.format(before="_pclose"),
        f"RSI_{spec.rsi}": f"case when pos - _rsi_move <= {ratio_rows(wilder_factor(spec.rsi))}"
        " then try_divide(100D * _w_gain, _w_gain + _w_loss) end",
        f"ATR_{spec.atr}": "_atr",
        "ATR_Norm": "try_divide(_atr, close)",
        f"ADX_{spec.adx}": "_w_dx",
        "BB_Width": f"case when pos >= {spec.bollinger - 1} then {width} end",
        "Hour_Sin": f"sin({TURN})",
        "Hour_Cos": f"cos({TURN})",
    }
    for n in emas:
        known[f"EMA_{n}"] = f"_ema_{n}"
        known[f"Dist_EMA_{n}"] = f"try_divide(close - _ema_{n}, close)"
    return df.withColumns(texts({c: known[c] for c in columns}))


def add_indicators(
    bars: DataFrame,
    columns: Sequence[str],
    spec: Indicators = Indicators(),
    keys: Sequence[str] = ("symbol", "timeframe"),
    layout: Layout = Layout(),
    label: Barriers | None = None,
    positions: str = "count",
) -> DataFrame:
    """Add the named columns to the bars, and with ``label`` also ``Target``.

    ``positions`` as in ``with_position``. RSI and ADX compare ups with downs, so they stay as they
    are while nothing moves; after 600 time constants without a move (8,096 bars for length 14)
    they are NULL. Known names: Log_Return, EMA_<n>, Dist_EMA_<n>, RSI_<n>, ATR_<n>, ATR_Norm, ADX_<n>,
    BB_Width, Hour_Sin, Hour_Cos; <n> must be the length in ``spec`` except for the EMAs.
    """
    if label and label.window > layout.list_window:
        labelled = triple_barrier_label(bars, label, keys, layout, positions=positions)
        added = add_indicators(labelled, columns, spec, keys, layout, positions=positions)
        return added.select(*bars.columns, "Target", *columns)
    blocks = indicator_blocks(columns, spec, keys, layout, label.window if label else 0)
    df = blocks.spread(with_position(bars, keys, layout, positions=positions), positions)
    if label:
        df = add_target(df, blocks, label)
    df = indicator_columns(df, blocks, columns, spec)
    kept = [*bars.columns, *(["Target"] if label else []), *columns]
    return blocks.own_rows(df).select(*kept)


def log_returns(
    bars: DataFrame,
    keys: Sequence[str] = ("symbol", "timeframe"),
    layout: Layout = Layout(),
    name: str = "Log_Return",
    positions: str = "count",
) -> DataFrame:
    """ln(close / close of the bar before), on each series by itself."""
    blocks = Blocks(tuple(keys), 1, 0, layout)
    df = blocks.spread(with_position(bars, keys, layout, positions=positions), positions)
    df = df.withColumn(name, F.expr(LOG_RETURN.format(before=f"lag(close) {blocks.over()}")))
    return blocks.own_rows(df).select(*bars.columns, name)


def hour_cyclic(bars: DataFrame) -> DataFrame:
    return bars.withColumns(texts({"Hour_Sin": f"sin({TURN})", "Hour_Cos": f"cos({TURN})"}))


def base_features(
    bars: DataFrame,
    suffix: str = "",
    spec: Indicators = Indicators(),
    keys: Sequence[str] = ("symbol", "timeframe"),
    layout: Layout = Layout(),
    positions: str = "count",
) -> DataFrame:
    """RSI and EMA distances of a coarser timeframe, their names ending in ``suffix``."""
    columns = [f"RSI_{spec.rsi}", *[f"Dist_EMA_{n}" for n in spec.base_emas]]
    df = add_indicators(bars, columns, spec, keys, layout, positions=positions)
    return df.select(*keys, "time", *[F.col(c).alias(f"{c}{suffix}") for c in columns])


def macro_returns(
    bars: DataFrame, names: dict[str, str], layout: Layout = Layout(), positions: str = "count"
) -> DataFrame:
    """Log returns of the side symbols, one row per (symbol, time), the new name in ``series``.

    ``names`` maps a symbol to the name of its return column.
    """
    label = F.coalesce(*[F.when(F.col("symbol") == s, F.lit(n)) for s, n in names.items()])
    side = bars.where(F.col("symbol").isin(*names)).withColumn("series", label)
    return log_returns(side, layout=layout, name="value", positions=positions).select(
        "series", "symbol", "timeframe", "time", "value"
    )
