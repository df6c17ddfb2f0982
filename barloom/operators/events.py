"""From predictions to non-overlapping trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import Account, Barriers, Layout
from barloom.functions.trading import (
    Weight,
    gross_pips,
    max_confidence,
    on_signal,
    signal,
    weight_default,
)
from barloom.operators.labels import bars_ahead, first_touch, wins
from barloom.operators.series import Blocks, with_position
from barloom.operators.touches import SIDES, first_touches

YEARLY = ("symbol", "year")
CONFIDENCES = {"conf_up": "proba_hausse", "conf_flat": "proba_neutre", "conf_down": "proba_baisse"}

TRADE_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("net", T.DoubleType()),
        T.StructField("gross", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("result", T.StringType()),
    ]
)
TRADE_COLUMNS = tuple(TRADE_SCHEMA.names)


def join_prices(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Predictions with high, low and close of their bar; rows without a bar are lost."""
    return predictions.join(bars.select("symbol", "time", "high", "low", "close"), ["symbol", "time"])


def join_features(joined: DataFrame, table: DataFrame) -> DataFrame:
    """Add the features of the feature table; rows without features are lost."""
    features = [c for c in table.columns if c not in ("Target", "Spread")]
    return joined.join(table.select(*features), ["symbol", "time"])


def with_signals(inputs: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Add year, largest confidence and signal to every input row."""
    return inputs.withColumns(
        {"year": F.year("time"), "proba_max": max_confidence(), "signal": signal(threshold)}
    )


def with_weights(signals: DataFrame, weight: Weight = weight_default) -> DataFrame:
    return signals.withColumn("weight", on_signal(weight))


def signal_count(signals: DataFrame, keys: Sequence[str] = YEARLY) -> DataFrame:
    return signals.groupBy(*keys).agg(F.count_if(F.col("signal") != 0).alias("n_signals"))


def first_passage(
    signals: DataFrame,
    barriers: Barriers = Barriers(),
    keys: Sequence[str] = YEARLY,
    layout: Layout = Layout(),
    positions: str = "count",
) -> DataFrame:
    """Per signal row: how its trade ends and from which bar on the next one may start.

    Positions count the input rows of one (symbol, year), and no trade looks beyond them. A trade
    that neither barrier ends within the window is a timeout; if the series ends first it counts
    as stopped and nothing can follow.
    """
    blocks = Blocks(tuple(keys), 0, barriers.window, layout)
    columns = [c for c in ("spread", "proba_max", "signal") if c in signals.columns]
    if positions == "given":
        columns.append("pos")
    narrow = signals.select(*keys, "time", "high", "low", "close", *columns)
    rows = blocks.spread(with_position(narrow, keys, layout, positions=positions), positions)
    long = F.col("signal") == 1
    if barriers.window > layout.list_window:
        rows = first_touches(rows, blocks, barriers, SIDES, wanted="signal")
        touch = F.when(long, F.col("_touch_long")).otherwise(F.col("_touch_short"))
        won = F.when(long, F.col("_won_long")).otherwise(F.col("_won_short"))
        ahead = F.col("_seen")
    else:
        rows = rows.withColumn("_ahead", bars_ahead(blocks, barriers.window))
        rows = blocks.own_rows(rows).where(F.col("signal") != 0)
        entry, bars = F.col("close"), F.col("_ahead")
        first = F.when(long, first_touch(bars, entry, barriers, 1)).otherwise(
            first_touch(bars, entry, barriers, -1)
        )
        rows = rows.withColumn("_touch", first)
        bar = F.col("_touch")
        won = F.when(long, wins(bar, entry, barriers, 1)).otherwise(wins(bar, entry, barriers, -1))
        touch, ahead = bar["pos"], F.size(bars)
    full = ahead == barriers.window
    result = (
        F.when(won, F.lit("win"))
        .when(touch.isNull() & full, F.lit("loss_timeout"))
        .otherwise(F.lit("loss_sl"))
    )
    free_at = (
        F.when(touch.isNotNull(), touch)
        .when(full, F.col("pos") + barriers.window)
        .otherwise(F.col("pos") + ahead + 1)
    )
    seen = [c for c in columns if c != "pos"]
    return rows.select(*keys, "time", "pos", free_at.alias("free_at"), result.alias("result"), *seen)


def non_overlapping_events(
    events: DataFrame,
    window: int,
    keys: Sequence[str] = YEARLY,
    block: int = 1_024,
    fan: int = 1_024,
) -> DataFrame:
    """In time order per key, keep an event only if its ``pos`` is at or after the ``free_at`` of
    the event kept before it.

    Whether an event is kept depends on all earlier ones, yet no key is walked by one task. Inside
    a block of positions the events only matter through a table: for each of the window + 1 bars at
    which the previous trade may release the block, the bar at which the block is left. These
    tables are chained inside groups of ``fan`` blocks, the groups' own tables are chained per key,
    and then every block is walked with its true starting bar. A task thus sees at most ``block``
    events, ``fan`` tables, or one table per block * fan bars of a key.
    """
    keys = list(keys)
    wide = block * fan
    fields = [c for c in events.columns if c not in (*keys, "pos", "free_at")]
    # Numbers known not to be NULL spare the joins below a filter each, and with equal filters
    # Spark runs the common part, up to the shuffle of the events, once instead of three times.
    blocks = (
        events.withColumn("_block", F.expr(f"coalesce(pos div {block}, 0)"))
        .groupBy(*keys, "_block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "free_at", *fields))).alias("_events"))
    )

    def release(start: str) -> str:
        return f"transform(sequence(0, {window}), late -> {start} + late)"

    # From here on a bar is counted from the start of the series, so gaps need no special care.
    leave = (
        f"aggregate(_events, {release(f'_block * {block}')}, (bars, e) ->"
        " transform(bars, b -> if(b <= e.pos, e.free_at, b)))"
    )
    tables = blocks.select(*keys, "_block", F.expr(leave).alias("_leave"))
    groups = (
        tables.withColumn("_group", F.expr(f"coalesce(_block div {fan}, 0)"))
        .groupBy(*keys, "_group")
        .agg(F.sort_array(F.collect_list(F.struct("_block", "_leave"))).alias("_tables"))
    )
    through = f"t._leave[cast(greatest(b - t._block * {block}, 0) as int)]"
    leave_group = (
        f"aggregate(_tables, {release(f'_group * {wide}')}, (bars, t) ->"
        f" transform(bars, b -> {through}))"
    )
    tops = (
        groups.select(*keys, "_group", F.expr(leave_group).alias("_leave"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_group", "_leave"))).alias("_tables"))
    )

    def starts(name: str, first: str, width: int) -> str:
        """Walk a list of tables and note the bar at which each is entered."""
        seen = f"cast(array() as array<struct<{name}:bigint,_free:bigint>>)"
        step = f"t._leave[cast(greatest(a.bar - t.{name} * {width}, 0) as int)]"
        noted = f"concat(a.seen, array(named_struct('{name}', t.{name}, '_free', a.bar)))"
        return (
            f"inline(aggregate(_tables, named_struct('bar', {first}, 'seen', {seen}),"
            f" (a, t) -> named_struct('bar', {step}, 'seen', {noted}), a -> a.seen))"
        )

    group_starts = tops.select(*keys, F.expr(starts("_group", "0L", wide)))
    block_starts = groups.join(group_starts, [*keys, "_group"]).select(
        *keys, F.expr(starts("_block", "_free", block))
    )
    keep = (
        "aggregate(_events, named_struct('bar', _free, 'kept', cast(array() as array<bigint>)),"
        " (a, e) -> if(e.pos >= a.bar,"
        " named_struct('bar', e.free_at, 'kept', array_append(a.kept, e.pos)), a), a -> a.kept)"
    )
    walked = blocks.join(block_starts, [*keys, "_block"]).withColumn("_kept", F.expr(keep))
    return walked.select(*keys, F.expr("inline(filter(_events, e -> array_contains(_kept, e.pos)))"))


def trade_pnl(
    kept: DataFrame,
    barriers: Barriers = Barriers(),
    account: Account = Account(),
    weight: Weight = weight_default,
) -> DataFrame:
    """Add gross pips, weight and net pips."""
    return kept.withColumns(
        {"gross": gross_pips(barriers, account), "weight": weight(F.col("proba_max"))}
    ).withColumn("net", F.col("gross") * F.col("weight"))


def trades_table(priced: DataFrame) -> DataFrame:
    """The fixed columns of the trade table; an empty input gives an empty table of that schema."""
    return priced.select(*[F.col(f.name).cast(f.dataType) for f in TRADE_SCHEMA.fields])


def semi_join_entries(inputs: DataFrame, trades: DataFrame) -> DataFrame:
    """Input rows at whose time a trade was entered."""
    return inputs.join(trades.select("symbol", "time"), ["symbol", "time"], "left_semi")


def enrich_trades(trades: DataFrame, inputs: DataFrame) -> DataFrame:
    """Trades with the features and the three percentages seen at their entry."""
    out = {"high", "low", "close", "spread", "signal", "weight", "proba_max", "yhat", "y", "year"}
    features = [c for c in inputs.columns if c not in {"symbol", "time", *out, *CONFIDENCES}]
    seen = inputs.select(
        "symbol", "time", *features, *[F.col(c).alias(n) for c, n in CONFIDENCES.items()]
    )
    return trades.join(seen, ["symbol", "time"], "left")
