"""Parameters, passed to operators explicitly; nothing in the package reads globals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Barriers:
    """Distances of the profit target and the stop in pips, and the window in bars."""

    take_profit: float = 20.0
    stop_loss: float = 10.0
    window: int = 24
    pip_size: float = 0.0001

    @property
    def target_distance(self) -> float:
        return self.take_profit * self.pip_size

    @property
    def stop_distance(self) -> float:
        return self.stop_loss * self.pip_size


@dataclass(frozen=True)
class Account:
    """Costs per trade and the conversion from pips to a share of the capital."""

    commission: float = 0.0
    spread_units_per_pip: float = 10.0
    pip_value: float = 1.0
    capital: float = 10_000.0


@dataclass(frozen=True)
class Forest:
    trees: int = 200
    depth: int = 12
    min_leaf: int = 5
    bins: int = 32
    seed: int = 42
    repeats: int = 10


@dataclass(frozen=True)
class Split:
    """Training ends with ``train_end``; the two later years are out of sample.

    ``purge_hours`` cuts the end of the training span by the clock; ``purge_bars``, when set,
    cuts it by bars instead, which also covers labels that reach over a weekend.
    """

    train_end: int = 2023
    validate: int = 2024
    test: int = 2025
    purge_hours: int = 48
    purge_bars: int | None = None

    @property
    def evaluation_years(self) -> tuple[int, int]:
        return (self.validate, self.test)


@dataclass(frozen=True)
class Indicators:
    """Lengths and start conventions of the technical indicators.

    ``wilder_start``: "first" starts a Wilder mean at the first value, "adjusted" divides by the
    sum of the weights so far, "sma" starts it with the plain mean of the first n values.
    ``bollinger_sd``: "population" or "sample". ``first_range``: "null" or "high_low", the true
    range of a bar that has no bar before it.
    """

    emas: tuple[int, ...] = (9, 21, 50)
    base_emas: tuple[int, ...] = (20, 50)
    rsi: int = 14
    atr: int = 14
    adx: int = 14
    bollinger: int = 20
    bollinger_width: float = 2.0
    wilder_start: str = "first"
    bollinger_sd: str = "population"
    first_range: str = "null"


@dataclass(frozen=True)
class Layout:
    """How a long series is cut into pieces that different tasks can hold.

    ``slice_seconds``: width of the time slices used for numbering, as-of joins and running
    totals. Bar times are unique per series, so a slice holds at most width / bar length rows.
    ``block_rows``: rows per block for window operators, cut by position, so every block is
    equally large however many rows one symbol has. ``sub_rows`` divides ``block_rows`` and is
    the span over which an exponential mean is summed directly. Barriers with a window of up to
    ``list_window`` bars are found in lists of the bars ahead, longer ones by doubling frames.
    """

    slice_seconds: int = 30 * 86_400
    block_rows: int = 131_072
    sub_rows: int = 2_048
    list_window: int = 64


# The features that the published study leaves out of its model.
DROPPED_FEATURES = (
    "Dist_EMA_9",
    "Dist_EMA_21",
    "Log_Return",
    "XAU_Return",
    "CHF_Return",
    "Dist_EMA_50_D1",
    "BB_Width",
    "Hour_Cos",
    "Hour_Sin",
)

# The columns of the feature table after symbol and time.
ML_COLUMNS = (
    "Target",
    "Spread",
    "Log_Return",
    "Dist_EMA_9",
    "Dist_EMA_21",
    "Dist_EMA_50",
    "RSI_14",
    "ADX_14",
    "ATR_Norm",
    "BB_Width",
    "Hour_Sin",
    "Hour_Cos",
    "RSI_14_H4",
    "Dist_EMA_20_H4",
    "Dist_EMA_50_H4",
    "RSI_14_D1",
    "Dist_EMA_20_D1",
    "Dist_EMA_50_D1",
    "XAU_Return",
    "CHF_Return",
)
