"""Choosing a weight function on one year and confirming it on the next."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import Account, Barriers
from barloom.functions.trading import CANDIDATES, Weight
from barloom.operators.events import YEARLY
from barloom.operators.metrics import finish_record, input_totals, per_key, per_place


def weight_of(candidates: Mapping[str, Weight]) -> Column:
    """Weight by the name in the ``candidate`` column."""
    p = F.col("proba_max")
    cases = [F.when(F.col("candidate") == name, weight(p)) for name, weight in candidates.items()]
    return F.coalesce(*cases)


def names_of(candidates: Mapping[str, Weight]) -> Column:
    names = [F.struct(F.lit(c).alias("candidate"), F.lit(n).alias("place")) for n, c in enumerate(candidates)]
    return F.inline(F.array(*names))


def weighted(priced: DataFrame, candidates: Mapping[str, Weight]) -> DataFrame:
    return priced.withColumn("weight", weight_of(candidates)).withColumn(
        "net", F.col("gross") * F.col("weight")
    )


def sizing_sweep(
    priced: DataFrame,
    inputs: DataFrame,
    barriers: Barriers = Barriers(),
    account: Account = Account(),
    candidates: Mapping[str, Weight] = CANDIDATES,
) -> DataFrame:
    """Metrics per weight function.

    Which trades happen does not depend on the weight, so trades are priced once, and every
    function adds a column of net pips to them.
    """
    keys = [*YEARLY, "candidate", "place"]
    nets = [F.col("gross") * weight(F.col("proba_max")) for weight in candidates.values()]
    totals = input_totals(inputs, barriers).select("*", names_of(candidates))
    tried = totals.join(per_place(priced, nets, YEARLY), [*YEARLY, "place"], "left")
    return finish_record(tried, account, keys)


def best_candidate(sweep: DataFrame) -> DataFrame:
    """Per (symbol, year) the weight function with the largest profit, ties in list order."""
    row = F.struct("candidate", "profit_net")
    order = F.struct(F.col("profit_net"), -F.col("place"))
    best = sweep.groupBy(*YEARLY).agg(F.max_by(row, order).alias("_best"))
    return best.select(*YEARLY, "_best.*")


def confirm_on_test(
    best: DataFrame,
    priced: DataFrame,
    inputs: DataFrame,
    barriers: Barriers = Barriers(),
    account: Account = Account(),
    candidates: Mapping[str, Weight] = CANDIDATES,
) -> DataFrame:
    """Metrics of each symbol's chosen weight function on its test-year trades."""
    keys = [*YEARLY, "candidate"]
    chosen = best.select("symbol", "candidate")
    tried = weighted(priced.join(chosen, "symbol"), candidates)
    totals = input_totals(inputs, barriers).join(chosen, "symbol")
    return finish_record(totals.join(per_key(tried, keys), keys, "left"), account, keys)
