"""Plain SQL for the queries, written independently of the DataFrame code.

Exponential means are written out as weighted sums over all earlier bars, and overlapping events
are removed by a recursive query.
"""

from __future__ import annotations

EVENT_WIDTHS = {"H1": 3_600, "H4": 14_400, "H8": 28_800}
ORDER_WIDTHS = {"D1": 86_400, "D7": 604_800, "D14": 1_209_600}


def bars_sql(ticks: str, widths: dict[str, int]) -> str:
    return " UNION ALL ".join(
        f"""SELECT symbol, '{name}' AS timeframe,
            make_timestamp(epoch_us(time) // {w}000000 * {w}000000) AS time,
            CAST(first(px ORDER BY time, seq) AS DOUBLE) AS open,
            CAST(max(px) AS DOUBLE) AS high, CAST(min(px) AS DOUBLE) AS low,
            CAST(last(px ORDER BY time, seq) AS DOUBLE) AS close,
            CAST(count(*) AS DOUBLE) AS volume,
            CAST(last(spread ORDER BY time, seq) AS DOUBLE) AS spread
        FROM {ticks} GROUP BY symbol, epoch_us(time) // {w}000000"""
        for name, w in widths.items()
    )


def ema_seed(n: int) -> str:
    return f"""CASE WHEN pos < {n - 1} THEN 0
        WHEN pos = {n - 1} THEN avg(close) OVER (PARTITION BY symbol, timeframe ORDER BY pos
            ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)
        ELSE close * 2 / ({n} + 1.0) END AS z{n}"""


def ema_value(n: int) -> str:
    decay = f"pow(1 - 2 / ({n} + 1.0), a.pos - b.pos)"
    return f"CASE WHEN a.pos >= {n - 1} THEN sum(b.z{n} * {decay}) END AS ema{n}"


def wilder(column: str) -> str:
    return f"sum(b.{column} * pow(13.0 / 14, a.pos - b.pos))"


def indicator_ctes(prefix: str, bars: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """All indicators of all timeframes of one bar table."""
    emas = (9, 20, 21, 50)
    same = "a.symbol = b.symbol AND a.timeframe = b.timeframe AND b.pos <= a.pos"
    return {
        f"{prefix}_pos": (
            f"""SELECT *, row_number() OVER w - 1 AS pos, lag(close) OVER w AS pc,
                lag(high) OVER w AS ph, lag(low) OVER w AS pl
            FROM {bars} WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY time)""",
            (bars,),
        ),
        f"{prefix}_raw": (
            f"""SELECT *, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss,
                CASE WHEN pos > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
                CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS dmp,
                CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS dmn
            FROM {prefix}_pos""",
            (f"{prefix}_pos",),
        ),
        f"{prefix}_z": (
            f"""SELECT *, {', '.join(ema_seed(n) for n in emas)},
                CASE pos WHEN 0 THEN 0 WHEN 1 THEN gain ELSE gain / 14 END AS zg,
                CASE pos WHEN 0 THEN 0 WHEN 1 THEN loss ELSE loss / 14 END AS zl,
                CASE pos WHEN 0 THEN 0 WHEN 1 THEN dmp ELSE dmp / 14 END AS zp,
                CASE pos WHEN 0 THEN 0 WHEN 1 THEN dmn ELSE dmn / 14 END AS zn,
                CASE WHEN pos < 13 THEN 0 WHEN pos = 13 THEN
                    avg(tr) OVER (PARTITION BY symbol, timeframe ORDER BY pos
                        ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
                    ELSE tr / 14 END AS zr,
                avg(close) OVER t AS mean20, stddev_pop(close) OVER t AS sd20
            FROM {prefix}_raw WINDOW t AS (PARTITION BY symbol, timeframe ORDER BY pos
                ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
            (f"{prefix}_raw",),
        ),
        f"{prefix}_sum": (
            f"""SELECT a.symbol, a.timeframe, a.pos, {', '.join(ema_value(n) for n in emas)},
                {wilder('zg')} AS g, {wilder('zl')} AS l, {wilder('zp')} AS p, {wilder('zn')} AS n,
                CASE WHEN a.pos >= 13 THEN {wilder('zr')} END AS atr
            FROM {prefix}_z a JOIN {prefix}_z b ON {same} GROUP BY 1, 2, 3""",
            (f"{prefix}_z",),
        ),
        f"{prefix}_dx": (
            f"""SELECT symbol, timeframe, pos,
                CASE WHEN pos >= 13 AND p + n > 0 THEN 100 * abs(p - n) / (p + n) END AS dx,
                min(CASE WHEN pos >= 13 AND p + n > 0 THEN pos END)
                    OVER (PARTITION BY symbol, timeframe) AS first_dx
            FROM {prefix}_sum""",
            (f"{prefix}_sum",),
        ),
        f"{prefix}_adx": (
            f"""SELECT a.symbol, a.timeframe, a.pos,
                sum(b.dx * CASE WHEN b.pos = b.first_dx THEN 1 ELSE 1.0 / 14 END
                    * pow(13.0 / 14, a.pos - b.pos)) AS adx
            FROM {prefix}_dx a JOIN {prefix}_dx b ON {same} GROUP BY 1, 2, 3""",
            (f"{prefix}_dx",),
        ),
        f"{prefix}_feat": (
            f"""SELECT z.symbol, z.timeframe, z.time, z.pos, z.open, z.high, z.low, z.close,
                z.volume, z.spread, ln(z.close / z.pc) AS Log_Return,
                {', '.join(f's.ema{n} AS EMA_{n}, (z.close - s.ema{n}) / z.close AS Dist_EMA_{n}' for n in emas)},
                CASE WHEN s.g + s.l > 0 THEN 100 * s.g / (s.g + s.l) END AS RSI_14,
                s.atr / z.close AS ATR_Norm, x.adx AS ADX_14,
                CASE WHEN z.pos >= 19 THEN 4 * z.sd20 / z.mean20 END AS BB_Width
            FROM {prefix}_z z JOIN {prefix}_sum s USING (symbol, timeframe, pos)
            JOIN {prefix}_adx x USING (symbol, timeframe, pos)""",
            (f"{prefix}_z", f"{prefix}_sum", f"{prefix}_adx"),
        ),
    }


def label_cte(prefix: str, pos: str, timeframe: str, tp: int, sl: int, window: int = 24):
    """First bar of the next ``window`` at which each barrier is reached, and the label."""
    return {
        f"{prefix}_hits": (
            f"""SELECT a.symbol, a.time, a.pos, a.close, count(b.pos) AS ahead,
                min(CASE WHEN b.high >= a.close + {tp} THEN b.pos END) AS up_tp,
                min(CASE WHEN b.low <= a.close - {sl} THEN b.pos END) AS up_sl,
                min(CASE WHEN b.low <= a.close - {tp} THEN b.pos END) AS dn_tp,
                min(CASE WHEN b.high >= a.close + {sl} THEN b.pos END) AS dn_sl
            FROM {pos} a LEFT JOIN {pos} b ON a.symbol = b.symbol AND a.timeframe = b.timeframe
                AND b.pos BETWEEN a.pos + 1 AND a.pos + {window}
            WHERE a.timeframe = '{timeframe}' GROUP BY 1, 2, 3, 4""",
            (pos,),
        ),
        f"{prefix}_label": (
            f"""SELECT symbol, time, pos, close, CASE WHEN ahead < {window} THEN NULL
                WHEN long_win AND NOT short_win THEN 1
                WHEN short_win AND NOT long_win THEN -1 ELSE 0 END AS target
            FROM (SELECT *, up_tp IS NOT NULL AND (up_sl IS NULL OR up_tp < up_sl) AS long_win,
                dn_tp IS NOT NULL AND (dn_sl IS NULL OR dn_tp < dn_sl) AS short_win
                FROM {prefix}_hits)""",
            (f"{prefix}_hits",),
        ),
    }


def passage_cte(tp: int, sl: int, window: int):
    """How the trade of every signal ends and when the next may start."""
    return (
        f"""SELECT symbol, year, time, spread, proba_max, signal, pos,
            CASE WHEN tp IS NOT NULL AND (sl IS NULL OR tp < sl) THEN 'win'
                WHEN sl IS NOT NULL OR ahead < {window} THEN 'loss_sl' ELSE 'loss_timeout' END AS result,
            CASE WHEN least(tp, sl) IS NOT NULL THEN least(tp, sl)
                WHEN ahead < {window} THEN pos + ahead + 1 ELSE pos + {window} END AS free_at
        FROM (SELECT a.symbol, a.year, a.time, a.spread, a.proba_max, a.signal, a.pos,
                count(b.pos) AS ahead,
                min(CASE WHEN (a.signal = 1 AND b.high >= a.close + {tp})
                    OR (a.signal = -1 AND b.low <= a.close - {tp}) THEN b.pos END) AS tp,
                min(CASE WHEN (a.signal = 1 AND b.low <= a.close - {sl})
                    OR (a.signal = -1 AND b.high >= a.close + {sl}) THEN b.pos END) AS sl
            FROM sig a LEFT JOIN sig b ON a.symbol = b.symbol AND a.year = b.year
                AND b.pos BETWEEN a.pos + 1 AND a.pos + {window}
            WHERE a.signal <> 0 GROUP BY ALL)""",
        ("sig",),
    )


MODEL_COLUMNS = ("Log_Return", "Dist_EMA_50", "RSI_14", "ADX_14", "ATR_Norm", "BB_Width")
# The features of the table, in its order.
FEATURES = (
    "Log_Return Dist_EMA_9 Dist_EMA_21 Dist_EMA_50 RSI_14 ADX_14 ATR_Norm BB_Width Hour_Sin Hour_Cos"
    " RSI_14_H4 Dist_EMA_20_H4 Dist_EMA_50_H4 RSI_14_D1 Dist_EMA_20_D1 Dist_EMA_50_D1 XAU_Return"
    " CHF_Return"
).split()
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)

CANDIDATES = """(VALUES ('linear_0.5-1.5', 0), ('linear_0.8-1.2', 1), ('exp_0.5-1.5', 2),
    ('step', 3)) c(candidate, place)"""

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ev_ticks": (
        """SELECT event_type AS symbol, ts AS time, event_id AS seq,
            10000000 + CAST(sum(CAST(round(value * 100) AS BIGINT) - 5000)
                OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS px,
            CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS spread
        FROM events""",
        (),
    ),
    "od_ticks": (
        """SELECT o_orderpriority AS symbol, o_orderdate AS time, o_orderkey AS seq,
            1000000000 + CAST(sum(CAST(round(o_totalprice) AS BIGINT) - 250000)
                OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS px,
            o_custkey % 30 AS spread
        FROM orders""",
        (),
    ),
    "ev_bars": (bars_sql("ev_ticks", EVENT_WIDTHS), ("ev_ticks",)),
    "od_bars": (bars_sql("od_ticks", ORDER_WIDTHS), ("od_ticks",)),
    # The daily bars alone, for what needs no coarser ones.
    "day_bars": (bars_sql("od_ticks", {"D1": 86_400}), ("od_ticks",)),
    **indicator_ctes("ev", "ev_bars"),
    **indicator_ctes("od", "od_bars"),
    **indicator_ctes("day", "day_bars"),
    **indicator_ctes("late", "late_bars"),
    **label_cte("ev", "ev_pos", "H1", 40_000, 20_000),
    **label_cte("od", "od_pos", "D1", 800_000, 400_000),
    **label_cte("day", "day_pos", "D1", 800_000, 400_000),
    **label_cte("year", "day_pos", "D1", 4_000_000, 3_000_000, 250),
    "ev_side": (
        """SELECT CASE symbol WHEN 'purchase' THEN 'XAU_Return' ELSE 'CHF_Return' END AS series,
            symbol, time, ln(close / pc) AS value
        FROM ev_pos WHERE timeframe = 'H1' AND symbol IN ('purchase', 'click')""",
        ("ev_pos",),
    ),
    "od_side": (
        """SELECT CASE symbol WHEN '2-HIGH' THEN 'XAU_Return' ELSE 'CHF_Return' END AS series,
            symbol, time, ln(close / pc) AS value
        FROM od_pos WHERE timeframe = 'D1' AND symbol IN ('2-HIGH', '5-LOW')""",
        ("od_pos",),
    ),
    "merged": (
        """SELECT f.*, l.target AS Target, m.RSI_14 AS RSI_14_H4, m.Dist_EMA_20 AS Dist_EMA_20_H4,
            m.Dist_EMA_50 AS Dist_EMA_50_H4, c.RSI_14 AS RSI_14_D1,
            c.Dist_EMA_20 AS Dist_EMA_20_D1, c.Dist_EMA_50 AS Dist_EMA_50_D1,
            x.value AS XAU_Return, h.value AS CHF_Return, sin(0) AS Hour_Sin, cos(0) AS Hour_Cos
        FROM (SELECT * FROM od_feat WHERE timeframe = 'D1') f
        JOIN (SELECT symbol, time, target FROM od_label WHERE target IS NOT NULL) l
            ON f.symbol = l.symbol AND f.time = l.time
        ASOF LEFT JOIN (SELECT * FROM od_feat WHERE timeframe = 'D7') m
            ON f.symbol = m.symbol AND f.time >= m.time
        ASOF LEFT JOIN (SELECT * FROM od_feat WHERE timeframe = 'D14') c
            ON f.symbol = c.symbol AND f.time >= c.time
        ASOF LEFT JOIN (SELECT * FROM od_side WHERE series = 'XAU_Return') x ON f.time >= x.time
        ASOF LEFT JOIN (SELECT * FROM od_side WHERE series = 'CHF_Return') h ON f.time >= h.time""",
        ("od_feat", "od_label", "od_side"),
    ),
    "table_rows": (f"SELECT * FROM merged WHERE {COMPLETE}", ("merged",)),
    "late_bars": ("SELECT * FROM day_bars WHERE time >= TIMESTAMP '1998-01-01'", ("day_bars",)),
    "rule": (
        """SELECT symbol, time, high, low, close, target AS y, spread, u, n, d,
            CASE WHEN d >= n AND d >= u THEN -1 WHEN n >= u THEN 0 ELSE 1 END AS yhat,
            round(d * 100.0 / (u + n + d), 2) AS conf_down,
            round(n * 100.0 / (u + n + d), 2) AS conf_flat,
            round(u * 100.0 / (u + n + d), 2) AS conf_up
        FROM (SELECT p.*, l.target, CAST((p.pos * 7919 + 17) % 101 + 1 AS DOUBLE) AS u,
            CAST((p.pos * 6007 + 5) % 103 + 1 AS DOUBLE) AS n,
            CAST((p.pos * 4099 + 11) % 107 + 1 AS DOUBLE) AS d
            FROM day_pos p JOIN day_label l USING (symbol, time))""",
        ("day_pos", "day_label"),
    ),
    "sig": (
        f"""SELECT *, row_number() OVER (PARTITION BY symbol, year ORDER BY time) - 1 AS pos
        FROM (SELECT r.*, CAST(year(r.time) AS INTEGER) AS year,
                greatest(conf_up, conf_flat, conf_down) / 100 AS proba_max,
                CASE WHEN yhat = 1 AND conf_up / 100 >= 0.45 THEN 1
                    WHEN yhat = -1 AND conf_down / 100 >= 0.45 THEN -1 ELSE 0 END AS signal,
                {', '.join(f'f.{c}' for c in FEATURES)}
            FROM rule r JOIN table_rows f USING (symbol, time))""",
        ("rule", "table_rows"),
    ),
    "passage": passage_cte(800_000, 400_000, 24),
    "passage_long": passage_cte(4_000_000, 3_000_000, 250),
    "nxt": (
        """SELECT a.symbol, a.year, a.pos, min(b.pos) AS next_pos
        FROM passage a LEFT JOIN passage b ON a.symbol = b.symbol AND a.year = b.year
            AND b.pos >= a.free_at GROUP BY 1, 2, 3""",
        ("passage",),
    ),
    "taken": (
        """SELECT symbol, year, min(pos) AS pos FROM passage GROUP BY 1, 2
        UNION ALL
        SELECT t.symbol, t.year, n.next_pos FROM taken t JOIN nxt n
            ON t.symbol = n.symbol AND t.year = n.year AND t.pos = n.pos
        WHERE n.next_pos IS NOT NULL""",
        ("nxt",),
    ),
    "gross": (
        """SELECT p.*, CASE WHEN result = 'win' THEN 800000 - spread / 10
            ELSE -400000 - spread / 10 END AS gross
        FROM passage p JOIN taken USING (symbol, year, pos)""",
        ("passage", "taken"),
    ),
    "trades": (
        """SELECT *, gross * weight AS net
        FROM (SELECT *, least(greatest(0.8 + 0.4 * ((proba_max - 0.45) / 0.10), 0.8), 1.2) AS weight
            FROM gross)""",
        ("gross",),
    ),
    "enriched": (
        f"""SELECT t.symbol, t.year, t.time, t.net, t.gross, t.weight, t.result,
            {', '.join(f's.{c}' for c in FEATURES)}, s.conf_up AS proba_hausse,
            s.conf_flat AS proba_neutre, s.conf_down AS proba_baisse
        FROM trades t JOIN sig s USING (symbol, year, time)""",
        ("trades", "sig"),
    ),
    "tried": (
        """SELECT symbol, year, time, gross, candidate, place, gross * weight AS net
        FROM (SELECT g.*, c.candidate, c.place, CASE c.place
                WHEN 0 THEN 0.5 + least(greatest((proba_max - 0.45) / 0.15, 0), 1)
                WHEN 1 THEN 0.8 + 0.8 * least(greatest((proba_max - 0.45) / 0.10, 0), 1)
                WHEN 2 THEN 0.5 + pow(least(greatest((proba_max - 0.45) / 0.15, 0), 1), 2)
                ELSE CASE WHEN proba_max < 0.5 THEN 0.5 WHEN proba_max < 0.55 THEN 1.0
                    ELSE 1.5 END END AS weight
            FROM gross g CROSS JOIN """
        + CANDIDATES
        + ")",
        ("gross",),
    ),
}


def metrics_ctes(name: str, source: str, keys: str, base: str):
    """Metrics of a trade table per ``keys``, with a row for every row of ``base``."""
    return {
        f"{name}_equity": (
            f"""SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY time) AS peak
            FROM (SELECT *, sum(net) OVER (PARTITION BY {keys} ORDER BY time) AS equity
                FROM {source})""",
            (source,),
        ),
        f"{name}_span": (
            f"""SELECT {keys}, unnest(generate_series(min(date_trunc('day', time)),
                max(date_trunc('day', time)), INTERVAL 1 DAY)) AS day
            FROM {source} GROUP BY {keys}""",
            (source,),
        ),
        f"{name}_daily": (
            f"""SELECT {', '.join('s.' + k.strip() for k in keys.split(','))},
                CAST(s.day AS TIMESTAMP) AS day, coalesce(sum(t.net), 0) AS pnl
            FROM {name}_span s LEFT JOIN {source} t ON
                {' AND '.join(f's.{k.strip()} = t.{k.strip()}' for k in keys.split(','))}
                AND s.day = date_trunc('day', t.time) GROUP BY ALL""",
            (f"{name}_span", source),
        ),
        f"{name}_sharpe": (
            f"""SELECT {keys}, CAST(count(*) AS INTEGER) AS days,
                CASE WHEN count(*) > 1 AND stddev_samp(pnl) <> 0
                THEN avg(pnl) / stddev_samp(pnl) * sqrt(252) ELSE 0 END AS sharpe
            FROM {name}_daily GROUP BY {keys}""",
            (f"{name}_daily",),
        ),
        f"{name}_profit": (
            f"""SELECT {keys}, count(*) AS trades, sum(net) AS profit_net,
                min(equity - peak) AS dd,
                avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0.0 END) * 100 AS win_rate
            FROM {name}_equity GROUP BY {keys}""",
            (f"{name}_equity",),
        ),
        f"{name}_record": (
            f"""SELECT {keys}, trades, profit_net, dd, win_rate, sharpe, sharpe AS pips_sharpe,
                profit_net / 400000000 * 100 AS total_return_pct, dd / 400000000 * 100 AS max_dd_pct,
                bh AS bh_pips, bh / 400000000 * 100 AS bh_return_pct, profit_net - bh AS alpha_pips,
                profit_net / 400000000 * 100 - bh / 400000000 * 100 AS alpha_return_pct, n_signals
            FROM (SELECT {', '.join('x.' + k.strip() for k in keys.split(','))},
                    coalesce(trades, 0) AS trades, coalesce(profit_net, 0) AS profit_net,
                    coalesce(dd, 0) AS dd, coalesce(win_rate, 0) AS win_rate,
                    coalesce(sharpe, 0) AS sharpe, x.n_signals,
                    CASE WHEN trades IS NULL THEN 0 ELSE x.bh END AS bh
                FROM {base} x LEFT JOIN
                    (SELECT * FROM {name}_profit JOIN {name}_sharpe USING ({keys})) m ON
                    {' AND '.join(f'x.{k.strip()} = m.{k.strip()}' for k in keys.split(','))})""",
            (base, f"{name}_profit", f"{name}_sharpe"),
        ),
    }


CTES["hold"] = (
    """SELECT symbol, year, CAST(count_if(signal <> 0) AS BIGINT) AS n_signals,
        last(close ORDER BY time) - first(close ORDER BY time) AS bh
    FROM sig GROUP BY 1, 2""",
    ("sig",),
)
CTES["hold_tried"] = (f"SELECT * FROM hold CROSS JOIN {CANDIDATES}", ("hold",))
CTES.update(metrics_ctes("one", "trades", "symbol, year", "hold"))
CTES.update(metrics_ctes("many", "tried", "symbol, year, candidate, place", "hold_tried"))
CTES["best"] = (
    """SELECT symbol, year, candidate, profit_net FROM many_record
    WHERE year = 2000 AND candidate IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY symbol, year ORDER BY profit_net DESC, place) = 1""",
    ("many_record",),
)
CTES["raw"] = (
    """SELECT regexp_extract(o_orderpriority, '([A-Z]+)', 1) AS symbol, 'D1' AS timeframe,
        o_orderkey AS line, o_orderdate AS time, o_orderkey % 89 = 0 AS bad_time,
        o_orderkey % 97 = 0 OR o_orderkey % 83 = 0 OR o_orderkey % 79 = 0 AS incomplete,
        trunc(o_totalprice) AS price,
        CAST(o_custkey % 30 AS DOUBLE) AS spread
    FROM orders""",
    (),
)
CTES["clean"] = (
    """SELECT symbol, timeframe, time, price AS open, price AS high, price AS low,
        price AS close, CAST(1 AS DOUBLE) AS volume, spread
    FROM (SELECT * FROM raw WHERE NOT bad_time
        QUALIFY row_number() OVER (PARTITION BY symbol, time ORDER BY line) = 1)
    WHERE NOT incomplete""",
    ("raw",),
)
CTES["scored"] = (
    """SELECT CAST(year(time) AS INTEGER) AS year, y, yhat FROM rule
    WHERE y IS NOT NULL AND year(time) IN (2000, 2001)""",
    ("rule",),
)
CTES["class_scores"] = (
    """SELECT year, label, support, hits / greatest(predicted, 1) AS precision,
        hits / greatest(support, 1) AS recall,
        CASE WHEN hits = 0 THEN 0 ELSE 2.0 * hits / (predicted + support) END AS f1
    FROM (SELECT s.year, c.label, CAST(count_if(y = c.label) AS BIGINT) AS support,
            CAST(count_if(yhat = c.label) AS BIGINT) AS predicted,
            CAST(count_if(y = c.label AND yhat = c.label) AS DOUBLE) AS hits
        FROM scored s CROSS JOIN (VALUES (-1), (0), (1)) c(label) GROUP BY 1, 2)
    WHERE support + predicted > 0""",
    ("scored",),
)


def sql(body: str, *names: str) -> str:
    """``body`` after the named CTEs and all those they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][1]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    parts = []
    for name in order:
        kind = "" if name == "taken" else "MATERIALIZED "
        parts.append(f"{name} AS {kind}({CTES[name][0]})")
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def r(digits: int, *columns: str) -> str:
    """Rounded columns; adding zero turns a negative zero into a plain one."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


RECORD = (
    "profit_net",
    "dd",
    "win_rate",
    "sharpe",
    "pips_sharpe",
    "total_return_pct",
    "max_dd_pct",
    "bh_pips",
    "bh_return_pct",
    "alpha_pips",
    "alpha_return_pct",
)
EXPECTANCY = "CASE WHEN trades > 0 THEN profit_net / trades ELSE 0 END"
RATIO = "CASE WHEN trades > 0 THEN CAST(n_signals AS DOUBLE) / trades ELSE 0 END"


def feature(prefix: str, timeframe: str, digits: int, *columns: str) -> str:
    return sql(
        f"SELECT symbol, time, {r(digits, *columns)} FROM {prefix}_feat WHERE timeframe = '{timeframe}'",
        f"{prefix}_feat",
    )


def asof_coarse(lag: str) -> str:
    return sql(
        f"""SELECT f.symbol, f.time, f.close,
            round(m.RSI_14, 6) AS RSI_14_H4, round(m.Dist_EMA_20, 9) AS Dist_EMA_20_H4,
            round(m.Dist_EMA_50, 9) AS Dist_EMA_50_H4, round(c.RSI_14, 6) AS RSI_14_D1,
            round(c.Dist_EMA_20, 9) AS Dist_EMA_20_D1, round(c.Dist_EMA_50, 9) AS Dist_EMA_50_D1
        FROM (SELECT * FROM ev_feat WHERE timeframe = 'H1') f
        ASOF LEFT JOIN (SELECT * REPLACE (time + INTERVAL {lag} AS time) FROM ev_feat
            WHERE timeframe = 'H4') m ON f.symbol = m.symbol AND f.time >= m.time
        ASOF LEFT JOIN (SELECT * REPLACE (time + INTERVAL {lag} AS time) FROM ev_feat
            WHERE timeframe = 'H8') c ON f.symbol = c.symbol AND f.time >= c.time""",
        "ev_feat",
    )


def audit_row(step: str, before: str, after: str) -> str:
    return f"SELECT '{step}' AS step, ({before}) AS before, ({after}) AS after"


ML_9 = (
    "Log_Return",
    "Dist_EMA_9",
    "Dist_EMA_21",
    "Dist_EMA_50",
    "ATR_Norm",
    "BB_Width",
    "Hour_Sin",
    "Hour_Cos",
    "Dist_EMA_20_H4",
    "Dist_EMA_50_H4",
    "Dist_EMA_20_D1",
    "Dist_EMA_50_D1",
    "XAU_Return",
    "CHF_Return",
)
ML_6 = ("RSI_14", "ADX_14", "RSI_14_H4", "RSI_14_D1")

# The rule's importance: rows numbered by a hash, their values sent on by r -> (a r + b) mod n, with
# a and b from the seed, the feature and the repeat, a being the next number coprime to n.
PERMUTED = """, held AS (
    SELECT row_number() OVER (ORDER BY md5(symbol || '|' || strftime(time, '%Y-%m-%d %H:%M:%S'))) - 1 AS row,
        count(*) OVER () AS n, Target + 1 AS label, RSI_14, ATR_Norm
    FROM table_rows WHERE year(time) = 2000
), seeds AS (
    SELECT place, repeat, n, (((43 * 1000003 + place + 1) % 2147483647) * 1000003 + repeat + 1)
        % 2147483647 AS state
    FROM (SELECT DISTINCT n FROM held), range(2) p(place), range(10) q(repeat)
), maps AS (
    SELECT place, repeat, n, (SELECT min(x) FROM range(1 + state % n, 1 + state % n + 200) y(x)
        WHERE gcd(x, n) = 1) AS a, (state * 7919 + 104729) % n AS b FROM seeds
), moved AS (
    SELECT m.place, m.repeat, (m.a * h.row + m.b) % m.n AS row, CASE m.place WHEN 0 THEN h.RSI_14 END AS v
    FROM held h, maps m
), judged AS (
    SELECT m.place, m.repeat, h.label, coalesce(m.v, h.RSI_14) AS rsi FROM held h JOIN moved m USING (row)
    UNION ALL SELECT -1, 0, label, RSI_14 FROM held
), scored_rule AS (
    SELECT place, repeat, avg(CASE WHEN label = CASE WHEN rsi > 55 THEN 2 WHEN rsi < 45 THEN 0 ELSE 1 END
        THEN 1.0 ELSE 0.0 END) AS accuracy FROM judged GROUP BY 1, 2
), permuted AS (
    SELECT CASE place WHEN 0 THEN 'RSI_14' ELSE 'ATR_Norm' END AS feature,
        round_even((SELECT accuracy FROM scored_rule WHERE place = -1) - avg(accuracy), 5) + 0.0
            AS permutation_mean, round_even(stddev_pop(accuracy), 5) + 0.0 AS permutation_std
    FROM scored_rule WHERE place >= 0 GROUP BY place
)"""

COUNT = "SELECT CAST(count(*) AS BIGINT) FROM"
BOX = "proba_hausse, proba_neutre, proba_baisse"

ORACLE: dict[str, str] = {
    "clean_bars": sql("SELECT * FROM clean", "clean"),
    "clean_deliveries": sql("SELECT * FROM clean", "clean"),
    "raw_files": sql("SELECT * FROM clean", "clean"),
    "clean_summary": sql(
        """SELECT symbol, timeframe, count(*) AS rows, CAST(CAST(min(time) AS DATE) AS VARCHAR)
            AS first_day, CAST(CAST(max(time) AS DATE) AS VARCHAR) AS last_day
        FROM clean GROUP BY 1, 2""",
        "clean",
    ),
    "rejected_rows": sql(
        """SELECT symbol, count(*) AS rows, CAST(count_if(bad_time) AS BIGINT) AS rejected,
            count_if(bad_time) = count(*) AS unreadable FROM raw GROUP BY 1""",
        "raw",
    ),
    "label_triple_barrier": sql("SELECT symbol, time, close, target FROM ev_label", "ev_label"),
    "label_long_window": sql("SELECT symbol, time, close, target FROM year_label", "year_label"),
    "unlabelled_tail": sql(
        """SELECT symbol, count(*) AS rows, max(time) AS last_time FROM day_label
        WHERE target IS NOT NULL GROUP BY 1""",
        "day_label",
    ),
    "label_distribution": sql(
        """SELECT symbol, target, n,
            round(round_even(n / sum(n) OVER (PARTITION BY symbol), 4) * 100, 2) AS share_pct
        FROM (SELECT symbol, target, count(*) AS n FROM day_label WHERE target IS NOT NULL
            GROUP BY 1, 2)""",
        "day_label",
    ),
    "feat_log_return": sql(
        "SELECT symbol, time, round(ln(close / pc), 9) AS Log_Return FROM ev_pos WHERE timeframe = 'H1'",
        "ev_pos",
    ),
    "feat_ema": feature("ev", "H1", 2, "EMA_9", "EMA_20", "EMA_21", "EMA_50"),
    "feat_dist_ema": feature("ev", "H1", 9, "Dist_EMA_9", "Dist_EMA_21", "Dist_EMA_50"),
    "feat_rsi": feature("day", "D1", 6, "RSI_14"),
    "feat_atr_norm": feature("ev", "H1", 9, "ATR_Norm"),
    "feat_adx": feature("day", "D1", 6, "ADX_14"),
    "feat_bb_width": feature("ev", "H1", 8, "BB_Width"),
    "feat_hour_cyclic": sql(
        f"""SELECT symbol, time, {r(6, 'Hour_Sin', 'Hour_Cos')}
        FROM (SELECT symbol, time, sin(2 * pi() * hour(time) / 24) AS Hour_Sin,
            cos(2 * pi() * hour(time) / 24) AS Hour_Cos FROM ev_bars WHERE timeframe = 'H1')""",
        "ev_bars",
    ),
    "feat_increments": feature(
        "day", "D1", 6, "Log_Return", "Dist_EMA_9", "Dist_EMA_50", "RSI_14", "ADX_14", "ATR_Norm", "BB_Width"
    ),
    "feat_base_tf": sql(
        """SELECT symbol, timeframe, time, round(RSI_14, 6) AS RSI_14_C,
            round(Dist_EMA_20, 9) AS Dist_EMA_20_C, round(Dist_EMA_50, 9) AS Dist_EMA_50_C
        FROM ev_feat WHERE timeframe IN ('H4', 'H8')""",
        "ev_feat",
    ),
    "feat_macro_returns": sql(
        "SELECT series, symbol, time, round(value, 9) AS value FROM ev_side", "ev_side"
    ),
    "asof_multi_timeframe": asof_coarse("0 HOUR"),
    "asof_when_known": asof_coarse("8 HOUR"),
    "asof_sliced": asof_coarse("0 HOUR"),
    "asof_macro": sql(
        """SELECT f.symbol, f.time, f.close, round(x.value, 9) AS XAU_Return,
            round(h.value, 9) AS CHF_Return
        FROM (SELECT * FROM ev_pos WHERE timeframe = 'H1') f
        ASOF LEFT JOIN (SELECT * FROM ev_side WHERE series = 'XAU_Return') x ON f.time >= x.time
        ASOF LEFT JOIN (SELECT * FROM ev_side WHERE series = 'CHF_Return') h ON f.time >= h.time""",
        "ev_pos",
        "ev_side",
    ),
    "ml_table": sql(
        f"""SELECT symbol, time, Target, spread AS Spread, {r(9, *ML_9)}, {r(6, *ML_6)} FROM merged
        WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*ML_9, *ML_6))}""",
        "merged",
    ),
    "model_features": sql(
        f"""SELECT f.symbol, f.time, {r(9, 'Dist_EMA_50', 'ATR_Norm')}, {r(6, 'RSI_14', 'ADX_14')}
        FROM day_feat f JOIN day_label l ON f.symbol = l.symbol AND f.time = l.time
        WHERE l.target IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in MODEL_COLUMNS)}""",
        "day_feat",
        "day_label",
    ),
    "row_loss_audit": sql(
        "SELECT *, after - before AS delta, round(greatest(before - after, 0) / before * 100, 6)"
        " AS lost_pct, greatest(before - after, 0) / before * 100 > 5 AS flagged FROM ("
        + " UNION ALL ".join(
            [
                audit_row("label", f"{COUNT} day_bars", f"{COUNT} day_label WHERE target IS NOT NULL"),
                audit_row(
                    "features", f"{COUNT} day_label WHERE target IS NOT NULL", f"{COUNT} table_rows"
                ),
                audit_row(
                    "join prices",
                    "SELECT CAST(count(*) + count_if(day(time) % 10 = 7) AS BIGINT) FROM rule",
                    f"{COUNT} rule",
                ),
                audit_row("join features", f"{COUNT} rule", f"{COUNT} sig"),
            ]
        )
        + ")",
        "day_bars",
        "day_label",
        "table_rows",
        "rule",
        "sig",
    ),
    "merge_null_audit": sql(
        """SELECT merge, probe, total, nulls, round(100.0 * nulls / total, 6) AS null_pct,
            100.0 * nulls / total > 5 AS flagged FROM ("""
        + " UNION ALL ".join(
            f"""SELECT '{label}' AS merge, '{probe}' AS probe, count(*) AS total,
                count(*) - count({probe}) AS nulls FROM merged"""
            for label, probe in (
                ("middle", "RSI_14_H4"),
                ("coarse", "RSI_14_D1"),
                ("xau", "XAU_Return"),
                ("chf", "CHF_Return"),
            )
        )
        + ")",
        "merged",
    ),
    "purged_split": sql(
        """SELECT symbol, count(*) AS rows, max(time) AS last_time FROM day_bars
        WHERE time < TIMESTAMP '2000-01-01' - INTERVAL 48 HOUR GROUP BY 1""",
        "day_bars",
    ),
    "purged_split_bars": sql(
        """SELECT symbol, time, close FROM day_bars WHERE time < TIMESTAMP '2000-01-01'
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) > 24""",
        "day_bars",
    ),
    "year_slice": sql(
        """SELECT symbol, time, CAST(year(time) AS INTEGER) AS year, close FROM day_bars
        WHERE year(time) IN (2000, 2001)""",
        "day_bars",
    ),
    "max_confidence": sql(
        """SELECT symbol, time, round(greatest(conf_up, conf_flat, conf_down) / 100, 6) AS proba_max
        FROM rule""",
        "rule",
    ),
    "signals": sql(
        "SELECT symbol, time, year, yhat, signal, round(proba_max, 6) AS proba_max FROM sig", "sig"
    ),
    "weights": sql(
        """SELECT symbol, time, signal, round(p, 6) AS proba_max,
            CASE WHEN signal = 0 THEN 0 ELSE round(least(greatest(0.8 + 0.4 * ((p - 0.45) / 0.10), 0.8), 1.2), 6) END AS weight_default,
            CASE WHEN signal = 0 THEN 0 ELSE round(0.5 + least(greatest((p - 0.45) / 0.15, 0), 1), 6) END AS weight_0,
            CASE WHEN signal = 0 THEN 0 ELSE round(0.8 + 0.8 * least(greatest((p - 0.45) / 0.10, 0), 1), 6) END AS weight_1,
            CASE WHEN signal = 0 THEN 0 ELSE round(0.5 + pow(least(greatest((p - 0.45) / 0.15, 0), 1), 2), 6) END AS weight_2,
            CASE WHEN signal = 0 THEN 0.0 WHEN p < 0.5 THEN 0.5 WHEN p < 0.55 THEN 1.0 ELSE 1.5 END::DOUBLE AS weight_3
        FROM (SELECT *, proba_max AS p FROM sig)""",
        "sig",
    ),
    "signal_count": sql("SELECT symbol, year, n_signals FROM hold", "hold"),
    "first_passage": sql(
        "SELECT symbol, year, time, signal, pos, free_at, result FROM passage", "passage"
    ),
    "first_passage_long": sql(
        "SELECT symbol, year, time, signal, pos, free_at, result FROM passage_long", "passage_long"
    ),
    "non_overlapping_events": sql(
        "SELECT symbol, year, time, pos, free_at, result FROM gross", "gross"
    ),
    "trades": sql(
        f"SELECT symbol, year, time, result, {r(6, 'net', 'gross', 'weight')} FROM trades", "trades"
    ),
    "entries": sql(
        "SELECT s.symbol, s.time, s.close, s.signal FROM sig s JOIN trades t USING (symbol, time)",
        "sig",
        "trades",
    ),
    "trades_enriched": sql(
        f"""SELECT symbol, year, time, result, {BOX}, {r(6, 'net', 'gross', 'weight', *ML_6)},
            {r(9, *ML_9)} FROM enriched""",
        "enriched",
    ),
    "win_rate_profit": sql(
        f"SELECT symbol, year, trades, {r(6, 'win_rate', 'profit_net')} FROM one_profit", "one_profit"
    ),
    "equity_drawdown": sql(
        f"""SELECT symbol, year, time, {r(4, 'equity', 'peak')},
            round(equity - peak, 4) AS drawdown FROM one_equity""",
        "one_equity",
    ),
    "max_drawdown": sql("SELECT symbol, year, round(dd, 4) AS dd FROM one_profit", "one_profit"),
    "daily_pnl": sql("SELECT symbol, year, day, round(pnl, 4) AS pnl FROM one_daily", "one_daily"),
    "sharpe": sql(
        """SELECT symbol, year, days, round(sharpe, 6) AS sharpe, round(sharpe, 6) AS pips_sharpe
        FROM one_sharpe""",
        "one_sharpe",
    ),
    "buy_and_hold": sql("SELECT symbol, year, round(bh, 6) AS bh_pips FROM hold", "hold"),
    "metrics": sql(
        f"""SELECT symbol, year, trades, n_signals, {r(4, *RECORD)},
            round({EXPECTANCY}, 4) AS expectancy, round({RATIO}, 4) AS signal_ratio FROM one_record""",
        "one_record",
    ),
    "yearly_summary": sql(
        f"""SELECT symbol, year, trades, n_signals, {r(4, *RECORD)},
            round({EXPECTANCY}, 4) AS expectancy, round({RATIO}, 4) AS signal_ratio FROM one_record
        UNION ALL BY NAME
        SELECT symbol, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(n_signals) AS BIGINT) AS n_signals,
            round(sum(profit_net), 4) AS profit_net, round(min(dd), 4) AS dd
        FROM one_record GROUP BY ROLLUP (symbol)""",
        "one_record",
    ),
    "performance_report": sql(
        f"""SELECT symbol, year, concat_ws(chr(10), '# Performance report - ' || symbol,
            '**Year:** ' || year,
            '**Configuration:** TP=800000p / SL=400000p / Window=24 bars / Threshold=0.45 / Commission=0p / Capital=4e+08',
            '', '## Strategy', '| Metric | Value |', '| :--- | :--- |', '| Trades | ' || trades || ' |',
            printf('| Win rate | %.2f%% |', win_rate),
            printf('| Net result | %.1f pips (%+.2f%%) |', profit_net, total_return_pct),
            printf('| Max drawdown | %.1f pips (%.2f%%) |', dd, max_dd_pct),
            printf('| Expectancy | %.2f pips/trade |', {EXPECTANCY}),
            printf('| Sharpe (annualised returns) | %.2f |', sharpe),
            printf('| Sharpe (pips) | %.2f |', pips_sharpe),
            printf('| Signals / trades | %d / %d (x%.2f) |', n_signals, trades, {RATIO}),
            '', '## Buy and hold', '| Metric | Value |', '| :--- | :--- |',
            printf('| Buy and hold | %+.1f pips (%+.2f%%) |', bh_pips, bh_return_pct),
            printf('| Alpha | %+.1f pips (%+.2f%%) |', alpha_pips, alpha_return_pct)) AS report
        FROM one_record""",
        "one_record",
    ),
    "win_loss_filter": sql(
        """SELECT symbol, time, CASE WHEN net > 0 THEN 'winner' ELSE 'loser' END AS side,
            round(net, 6) AS net FROM trades WHERE net <> 0""",
        "trades",
    ),
    "loss_breakdown": sql(
        """SELECT symbol, year, count(*) AS trades, CAST(count_if(net < 0) AS BIGINT) AS losses,
            round(100.0 * count_if(net > 0) / count(*), 6) AS win_pct,
            CAST(count_if(net < 0 AND result = 'loss_sl') AS BIGINT) AS losses_stop,
            CAST(count_if(net < 0 AND result = 'loss_timeout') AS BIGINT) AS losses_timeout
        FROM trades GROUP BY 1, 2""",
        "trades",
    ),
    "mean_gap_top5": sql(
        "SELECT symbol, year, CAST(rank AS INTEGER) AS rank, feature, round(mean_win, 8) AS mean_win,"
        " round(mean_loss, 8) AS mean_loss, round(gap, 8) AS gap FROM (SELECT *, row_number() OVER"
        " (PARTITION BY symbol, year ORDER BY gap DESC NULLS LAST, place) AS rank FROM ("
        "SELECT *, abs(mean_win - mean_loss) AS gap FROM ("
        + " UNION ALL ".join(
            f"""SELECT symbol, year, '{c}' AS feature, {n} AS place,
                avg({c}) FILTER (net > 0) AS mean_win, avg({c}) FILTER (net < 0) AS mean_loss
            FROM enriched GROUP BY 1, 2"""
            for n, c in enumerate(FEATURES)
        )
        + "))) WHERE rank <= 5",
        "enriched",
    ),
    "box_stats": sql(
        f"""SELECT result, trades, round(q1, 4) AS q1, round(median, 4) AS median,
            round(q3, 4) AS q3, round(min(v) FILTER (inside), 4) AS whisker_low,
            round(max(v) FILTER (inside), 4) AS whisker_high,
            CAST(count_if(NOT inside) AS BIGINT) AS outliers
        FROM (SELECT *, v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) AS inside
            FROM (SELECT result, greatest({BOX}) AS v, count(*) OVER k AS trades,
                    quantile_cont(greatest({BOX}), 0.25) OVER k AS q1,
                    quantile_cont(greatest({BOX}), 0.5) OVER k AS median,
                    quantile_cont(greatest({BOX}), 0.75) OVER k AS q3
                FROM enriched WINDOW k AS (PARTITION BY result)))
        GROUP BY result, trades, q1, median, q3""",
        "enriched",
    ),
    "sizing_sweep": sql(
        f"""SELECT symbol, year, candidate, place, trades, n_signals, {r(4, *RECORD)}
        FROM many_record WHERE year = 2000 AND candidate IS NOT NULL""",
        "many_record",
    ),
    "best_candidate": sql(
        "SELECT symbol, year, candidate, round(profit_net, 4) AS profit_net FROM best", "best"
    ),
    "confirm_on_test": sql(
        f"""SELECT m.symbol, m.year, m.candidate, m.trades, m.n_signals,
            {', '.join(f'round(m.{c}, 4) AS {c}' for c in RECORD)}
        FROM many_record m JOIN best b ON m.symbol = b.symbol AND m.candidate = b.candidate
        WHERE m.year = 2001""",
        "many_record",
        "best",
    ),
    "class_weights": sql(
        """SELECT target, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6)
            AS class_weight
        FROM (SELECT target, count(*) AS n FROM day_label WHERE target IS NOT NULL
            AND time < TIMESTAMP '2000-01-01' - INTERVAL 48 HOUR GROUP BY 1)""",
        "day_label",
    ),
    "prediction_table": sql(
        """SELECT symbol, time, y, yhat, round_even(d / (u + n + d) * 100, 2) AS conf_down,
            round_even(n / (u + n + d) * 100, 2) AS conf_flat,
            round_even(u / (u + n + d) * 100, 2) AS conf_up, spread FROM rule""",
        "rule",
    ),
    "accuracy": sql(
        """SELECT year, count(*) AS support, round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END), 6)
            AS accuracy FROM scored GROUP BY 1""",
        "scored",
    ),
    "classification_report": sql(
        f"""SELECT year, CAST(label AS VARCHAR) AS label, support, {r(6, 'precision', 'recall', 'f1')}
        FROM class_scores
        UNION ALL SELECT year, 'macro avg', CAST(sum(support) AS BIGINT), round(avg(precision), 6),
            round(avg(recall), 6), round(avg(f1), 6) FROM class_scores GROUP BY 1
        UNION ALL SELECT year, 'weighted avg', CAST(sum(support) AS BIGINT),
            round(sum(precision * support) / sum(support), 6),
            round(sum(recall * support) / sum(support), 6),
            round(sum(f1 * support) / sum(support), 6) FROM class_scores GROUP BY 1""",
        "class_scores",
    ),
    "rejected_files": sql(
        """SELECT symbol, count(*) AS rows, CAST(count_if(bad_time) AS BIGINT) AS rejected,
            count_if(bad_time) = count(*) AS unreadable FROM raw GROUP BY 1""",
        "raw",
    ),
    "bars_round_trip": sql("SELECT * FROM day_bars", "day_bars"),
    "rewritten_year": sql(
        """SELECT CAST(year(time) AS INTEGER) AS year, count(*) AS rows,
            CAST(sum(volume + CASE WHEN year(time) = 2000 THEN 1000 ELSE 0 END) AS DOUBLE) AS volume,
            count(DISTINCT symbol) AS symbols
        FROM day_bars WHERE year(time) <> 2000 OR symbol <> '5-LOW' GROUP BY 1""",
        "day_bars",
    ),
    "missing_year": sql(
        """SELECT CAST(year(time) AS INTEGER) AS year, count(*) AS rows FROM day_bars
        WHERE year(time) IN (2000, 2035) GROUP BY 1""",
        "day_bars",
    ),
    "feat_ema_since": feature("late", "D1", 2, "EMA_20", "EMA_50"),
    "permutation_by_rule": sql(f"{PERMUTED} SELECT * FROM permuted", "table_rows"),
    "importance_filter": sql(
        f"{PERMUTED} SELECT * FROM permuted WHERE permutation_mean >= 2 * permutation_std", "table_rows"
    ),
    "forest_checks": sql(
        """SELECT CAST(year(time) AS INTEGER) AS year, count(*) AS rows, CAST(0 AS BIGINT) AS wrong_sum,
            CAST(0 AS BIGINT) AS not_most FROM table_rows WHERE year(time) IN (2000, 2001) GROUP BY 1""",
        "table_rows",
    ),
    "impurity_checks": """SELECT CAST(9 AS BIGINT) AS features, CAST(100 AS DOUBLE) AS total_pct,
        CAST(0 AS BIGINT) AS negative, 'ADX_14,ATR_Norm,Dist_EMA_20_D1,Dist_EMA_20_H4,Dist_EMA_50,'
        || 'Dist_EMA_50_H4,RSI_14,RSI_14_D1,RSI_14_H4' AS names""",
}
