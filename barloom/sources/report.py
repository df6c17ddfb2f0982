"""Text report per (symbol, year)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import Account, Barriers


def config_line(barriers: Barriers, account: Account, threshold: float) -> str:
    return (
        f"TP={barriers.take_profit:g}p / SL={barriers.stop_loss:g}p / "
        f"Window={barriers.window} bars / Threshold={threshold:g} / "
        f"Commission={account.commission:g}p / Capital={account.capital:g}"
    )


def report_text(
    barriers: Barriers,
    account: Account,
    threshold: float,
    version: str | None = None,
    notes: str | None = None,
) -> Column:
    """The report as one string column over a metrics table with ratios."""

    def line(text: str, *columns: str) -> Column:
        return F.format_string(text, *[F.col(c) for c in columns]) if columns else F.lit(text)

    head = [
        line("# Performance report - %s", "symbol"),
        line("**Year:** %d", "year"),
        *([line(f"**Version:** {version}")] if version else []),
        line(f"**Configuration:** {config_line(barriers, account, threshold)}"),
        line(""),
        line("## Strategy"),
        line("| Metric | Value |"),
        line("| :--- | :--- |"),
        line("| Trades | %d |", "trades"),
        line("| Win rate | %.2f%% |", "win_rate"),
        line("| Net result | %.1f pips (%+.2f%%) |", "profit_net", "total_return_pct"),
        line("| Max drawdown | %.1f pips (%.2f%%) |", "dd", "max_dd_pct"),
        line("| Expectancy | %.2f pips/trade |", "expectancy"),
        line("| Sharpe (annualised returns) | %.2f |", "sharpe"),
        line("| Sharpe (pips) | %.2f |", "pips_sharpe"),
        line("| Signals / trades | %d / %d (x%.2f) |", "n_signals", "trades", "signal_ratio"),
        line(""),
        line("## Buy and hold"),
        line("| Metric | Value |"),
        line("| :--- | :--- |"),
        line("| Buy and hold | %+.1f pips (%+.2f%%) |", "bh_pips", "bh_return_pct"),
        line("| Alpha | %+.1f pips (%+.2f%%) |", "alpha_pips", "alpha_return_pct"),
    ]
    tail = [line(""), line("## Notes"), line(notes)] if notes else []
    return F.concat_ws("\n", *head, *tail)


def performance_report(
    metrics: DataFrame,
    barriers: Barriers = Barriers(),
    account: Account = Account(),
    threshold: float = 0.45,
    version: str | None = None,
    notes: str | None = None,
) -> DataFrame:
    text = report_text(barriers, account, threshold, version, notes)
    return metrics.select("symbol", "year", text.alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder per (symbol, year) with its report as text."""
    reports.select("symbol", "year", F.col("report").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("symbol", "year").text(path)
