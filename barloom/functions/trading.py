"""Column expressions on predictions and trades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.config import Account, Barriers

Weight = Callable[[Column], Column]


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def max_confidence() -> Column:
    """Largest of the three class percentages, as a fraction."""
    return F.greatest("conf_up", "conf_flat", "conf_down") / 100


def normalise_threshold(threshold: float) -> float:
    """Values below 1 are fractions, all others percentages."""
    return threshold if threshold < 1 else threshold / 100


def signal(threshold: float) -> Column:
    """1 or -1 where the predicted side is confident enough, else 0."""
    enough = normalise_threshold(threshold)
    up = (F.col("yhat") == 1) & (F.col("conf_up") / 100 >= enough)
    down = (F.col("yhat") == -1) & (F.col("conf_down") / 100 >= enough)
    return F.when(up, F.lit(1)).when(down, F.lit(-1)).otherwise(F.lit(0))


def weight_default(p: Column) -> Column:
    return clip((p - 0.45) / 0.10 * 0.4 + 0.8, 0.8, 1.2)


def weight_linear(p: Column, threshold: float = 0.45) -> Column:
    return clip((p - threshold) / 0.15, 0.0, 1.0) + 0.5


def weight_gentle(p: Column, threshold: float = 0.45) -> Column:
    """From 0.8 to 1.6, whatever the published name of this candidate says."""
    return clip((p - threshold) / 0.10, 0.0, 1.0) * 0.8 + 0.8


def weight_square(p: Column, threshold: float = 0.45) -> Column:
    share = clip((p - threshold) / 0.15, 0.0, 1.0)
    return share * share + 0.5


def weight_step(p: Column) -> Column:
    return F.when(p < 0.50, F.lit(0.5)).when(p < 0.55, F.lit(1.0)).otherwise(F.lit(1.5))


# Names of the weight functions that compete, in the order that settles ties.
CANDIDATES: dict[str, Weight] = {
    "linear_0.5-1.5": weight_linear,
    "linear_0.8-1.2": weight_gentle,
    "exp_0.5-1.5": weight_square,
    "step": weight_step,
}


def on_signal(weight: Weight) -> Column:
    """The weight where there is a signal, 0 elsewhere."""
    return F.when(F.col("signal") != 0, weight(F.col("proba_max"))).otherwise(F.lit(0.0))


def trade_cost(account: Account) -> Column:
    return F.col("spread") / account.spread_units_per_pip + account.commission


def gross_pips(barriers: Barriers, account: Account) -> Column:
    """Target or stop distance less costs; a timeout books the full stop."""
    cost = trade_cost(account)
    won = F.col("result") == "win"
    return F.when(won, -cost + barriers.take_profit).otherwise(-cost - barriers.stop_loss)


def pips_to_return(pips: Column, account: Account) -> Column:
    return pips * account.pip_value / account.capital


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def expectancy() -> Column:
    return or_zero(F.try_divide(F.col("profit_net"), F.col("trades").cast("double")))


def signal_ratio() -> Column:
    return or_zero(F.try_divide(F.col("n_signals").cast("double"), F.col("trades").cast("double")))
