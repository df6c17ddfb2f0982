"""What the plans of the costly steps must not do."""

from datetime import datetime, timedelta

from helpers import START, bars_frame, random_walk
from pyspark.sql import functions as F

from barloom.checks.queries import QUERIES
from barloom.operators import sizing
from barloom.operators.audit import row_loss_audit
from barloom.operators.events import enrich_trades
from barloom.sources.ticks import bars_from_ticks

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    """The plan as first made; what adaptive execution does to it comes later."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def test_ticks_are_read_once(spark):
    for name in ("label_triple_barrier", "feat_adx", "label_distribution", "feat_log_return"):
        assert plan_of(QUERIES[name](spark, SF_DIR)).count("FileScan") == 1, name


def test_a_busy_slice_is_cut_into_parts(spark):
    """All ticks of one symbol in one slice: bars are the same, and no group holds the whole slice."""
    rows = [
        ("X", START + timedelta(seconds=i // 50), i, (i * 7) % 11 - 5, i % 3) for i in range(20_000)
    ]
    ticks = spark.createDataFrame(rows, "symbol string, time timestamp_ntz, seq long, delta long, spread int")
    second = F.minute("time") * 60 + F.second("time")
    whole = bars_from_ticks(ticks, {"M10": 600, "H1": 3_600}, 0, 600)
    cut = bars_from_ticks(ticks, {"M10": 600, "H1": 3_600}, 0, 600, part=second)
    assert sorted(cut.collect()) == sorted(whole.collect())
    assert "_part" in plan_of(cut) and ticks.groupBy(second).count().agg(F.max("count")).first()[0] == 50


def test_bars_carry_their_positions(spark):
    rows = [("XY"[i % 2], START + timedelta(minutes=37 * i * i % 9_000), i, 1, 0) for i in range(300)]
    ticks = spark.createDataFrame(rows, "symbol string, time timestamp_ntz, seq long, delta long, spread int")
    found = bars_from_ticks(ticks, {"H1": 3_600, "H4": 14_400}, 0, 600).collect()
    for symbol in "XY":
        for timeframe in ("H1", "H4"):
            own = sorted((r.time, r.pos) for r in found if (r.symbol, r.timeframe) == (symbol, timeframe))
            assert [p for _, p in own] == list(range(len(own)))


def test_trades_are_not_repeated_per_weight_function(spark):
    rows = [("X", 2024, datetime(2024, 1, 1 + i // 20, i % 20), 10.0 - i % 3 * 9, 0.4 + i % 30 / 100) for i in range(200)]
    priced = spark.createDataFrame(rows, "symbol string, year int, time timestamp_ntz, gross double, proba_max double")
    inputs = priced.select("symbol", "year", "time", F.lit(1).alias("signal"), F.lit(1.0).alias("close"))
    swept = sizing.sizing_sweep(priced, inputs)
    plan = plan_of(swept)
    assert plan.count("Generate inline") == 2  # day rows and totals
    assert swept.count() == 4 and swept.agg(F.min("trades"), F.max("trades")).first()[:] == (200, 200)


def test_trades_are_enriched_by_one_join(spark):
    inputs = bars_frame(spark, random_walk(20, seed=1)).withColumns(
        {c: F.lit(1.0) for c in ("conf_up", "conf_flat", "conf_down", "RSI_14")}
    )
    trades = inputs.select("symbol", "time", F.lit(1.0).alias("net")).where("close > 0")
    assert plan_of(enrich_trades(trades, inputs)).count("Join") == 1


def test_every_stage_is_counted_once(spark):
    stages = [(f"s{n}", spark.range(10 - n)) for n in range(4)]
    audit = row_loss_audit([stages])
    assert plan_of(audit).count("Range (") == 4
    assert [r.after for r in audit.orderBy("step").collect()] == [9, 8, 7]


def test_no_copy_is_ranked_for_a_permutation(spark):
    assert "Window" not in plan_of(QUERIES["permutation_by_rule"](spark, SF_DIR))
