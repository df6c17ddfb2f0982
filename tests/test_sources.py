from pathlib import Path

import pytest
from helpers import bars_frame, random_walk
from pyspark.sql import functions as F

from barloom.config import Account, Barriers
from barloom.operators.audit import merge_null_audit, row_loss_audit
from barloom.operators.cleaning import clean_bars, clean_summary, parse_number
from barloom.session import products, shared_folder, stored
from barloom.sources.bar_files import (
    BAR_SCHEMA,
    FILE_ORDER,
    checked_files,
    cleaned_name,
    discover_bar_files,
    only_readable,
    optional_source,
    read_bars,
    read_raw_bars,
    rejected_rows,
    write_table,
)
from barloom.sources.report import performance_report, write_reports

HEAD = "Time\tOpen\tHigh\tLow\tClose\tVolume\tSpread\n"


def line(time, close="1.5", tail=""):
    return f"{time}\t1\t2\t0.5\t{close}\t10\t3{tail}\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "EURUSD_H1.csv").write_text(
        HEAD
        + line("2024-01-01 02:00:00")
        + line("2024-01-01 00:00:00", "1.1")
        + line("2024-01-01 00:00:00", "9.9")  # second copy of a complete row
        + line("garbage")
        + line("2024.01.01 05:00")  # another format
        + line("2024-01-01 03:00:00", "")  # first copy incomplete: the time is lost
        + line("2024-01-01 03:00:00", "1.3")
        + line("2024-01-01 04:00:00", "NaN")
        + line("2024-01-01 06:00:00", "abc")
        + line("2024-01-01 07:00:00", tail="\textra\tmore")
        + "2024-01-01 08:00:00\t1\t2\n"
    )
    (tmp_path / "XAUUSD_H4.csv").write_text(line("2024-02-01 04:00:00") + line("2024-02-01 00:00:00"))
    (tmp_path / "USDCHF_H1.csv").write_text("")
    (tmp_path / "BROKEN_D1.csv").write_text("not\na bar file\nat all\n")
    (tmp_path / "notes.txt").write_text(line("2024-03-01 00:00:00"))
    return str(tmp_path)


def cleaned(spark, folder):
    return clean_bars(read_raw_bars(spark, folder), FILE_ORDER)


def test_clean_rows(spark, folder):
    rows = cleaned(spark, folder).where("symbol = 'EURUSD'").orderBy("time").collect()
    assert [(r.time.hour, r.close) for r in rows] == [(0, 1.1), (2, 1.5), (7, 1.5)]
    assert {r.timeframe for r in rows} == {"H1"}


def test_file_without_heading_and_other_files_go_on(spark, folder):
    got = {(r.symbol, r.timeframe, r.rows, str(r.first_day)) for r in clean_summary(cleaned(spark, folder)).collect()}
    assert got == {("EURUSD", "H1", 3, "2024-01-01"), ("XAUUSD", "H4", 2, "2024-02-01")}


def test_unreadable_file_is_reported(spark, folder):
    files = discover_bar_files(spark, folder)
    report = rejected_rows(read_raw_bars(spark, folder), files).collect()
    got = {r.file.rsplit("/", 1)[1]: r for r in report}
    assert got["USDCHF_H1.csv"].unreadable and got["USDCHF_H1.csv"].rows == 0
    assert got["BROKEN_D1.csv"].unreadable and not got["EURUSD_H1.csv"].unreadable
    assert (got["EURUSD_H1.csv"].rows, got["EURUSD_H1.csv"].rejected) == (11, 2)


def test_discovery(spark, folder, tmp_path):
    assert discover_bar_files(spark, folder).count() == 4
    with pytest.raises(FileNotFoundError):
        discover_bar_files(spark, folder, "*.parquet")


def test_names(spark):
    df = spark.createDataFrame([("EURUSD_H1.csv",)], "n string").select(cleaned_name(F.col("n")))
    assert df.first()[0] == "EURUSD_H1_cleaned.csv"


def test_round_trip_and_missing_table(spark, tmp_path):
    bars = bars_frame(spark, random_walk(50, seed=4))
    path = str(tmp_path / "bars")
    write_table(bars, path, ["symbol", "timeframe"], ["time"])
    write_table(bars, path, ["symbol", "timeframe"], ["time"])
    back = read_bars(spark, path)
    assert sorted(back.select(*BAR_SCHEMA.names).collect()) == sorted(bars.collect())
    assert optional_source(spark, path, BAR_SCHEMA).count() == 50
    assert optional_source(spark, str(tmp_path / "none"), BAR_SCHEMA).count() == 0


def test_csv_round_trip(spark, tmp_path):
    bars = bars_frame(spark, random_walk(20, seed=4))
    path = str(tmp_path / "csv")
    bars.write.option("header", True).csv(path)
    assert sorted(read_bars(spark, path, "csv").collect()) == sorted(bars.collect())


def test_stored_products_lie_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark).startswith(base)
    kept = stored(bars_frame(spark, random_walk(20, seed=4)), ["timeframe"])
    assert kept.count() == 20 and kept.inputFiles()[0].startswith(f"file://{base}")


def test_row_loss(spark):
    ten, nine, none = spark.range(10), spark.range(9), spark.range(0)
    chains = [[("", ten), ("a", nine), ("b", ten)], [("", none), ("c", none)]]
    got = {r.step: r for r in row_loss_audit(chains).collect()}
    assert (got["a"].delta, got["a"].lost_pct, got["a"].flagged) == (-1, 10.0, True)
    assert (got["b"].delta, got["b"].lost_pct, got["b"].flagged) == (1, 0.0, False)
    assert (got["c"].before, got["c"].lost_pct, got["c"].flagged) == (0, 0.0, False)


def test_row_loss_per_key_names_keys_that_are_gone(spark):
    some = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    got = {(r.k, r.before, r.after) for r in row_loss_audit([[("", some), ("a", some.where("v < 2"))]], ["k"]).collect()}
    assert got == {("x", 2, 1), ("y", 1, 0)}


def test_a_file_that_fails_on_the_way_is_reported_and_the_others_go_on(spark, tmp_path):
    good, bad = tmp_path / "GOODUS_H1.csv", tmp_path / "BADUSD_H1.csv"
    good.write_text(HEAD + line("2024-01-01 00:00:00"))
    bad.write_text(HEAD + "".join(line(f"2024-01-{d:02d} {h:02d}:00:00") for d in range(1, 29) for h in range(24)))
    (tmp_path / ".BADUSD_H1.csv.crc").write_bytes(b"crc\x00\x00\x00\x02\x00" + b"\x01\x02\x03\x04" * 60)
    raw, files = read_raw_bars(spark, str(tmp_path)), checked_files(spark, str(tmp_path))
    report = {r.file.rsplit("/", 1)[1]: r.unreadable for r in rejected_rows(raw, files).collect()}
    assert report == {"GOODUS_H1.csv": False, "BADUSD_H1.csv": True}
    assert [r.symbol for r in clean_bars(only_readable(raw, files), FILE_ORDER).collect()] == ["GOODUS"]


def test_every_file_has_its_own_time_format(spark, tmp_path):
    for n, (first, second) in enumerate(
        [("2024.01.02 03:00:00", "2024.01.02 04:00:00"), ("2024-01-02 03:00", "2024-01-02 04:00"), ("2024-01-02", "2024-01-03")]
    ):
        (tmp_path / f"AAABB{'CDE'[n]}_H1.csv").write_text(HEAD + line("garbage") + line(first) + line(second) + line("2024-01-05T01:00:00"))
    got = clean_summary(clean_bars(read_raw_bars(spark, str(tmp_path)), FILE_ORDER)).collect()
    assert {(r.symbol, r.rows) for r in got} == {("AAABBC", 2), ("AAABBD", 2), ("AAABBE", 2)}


def test_numbers_are_decimal_numbers(spark):
    texts = ["12", " -1.5e3 ", ".5", "5.", "12d", "1.5f", "Infinity", "inf", "NaN", "1e999", "0x1p3", "", "1,5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_number(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [12.0, -1500.0, 0.5, 5.0, *[None] * 10]


def test_products_end_with_their_owner(spark, tmp_path):
    before = stored(bars_frame(spark, random_walk(5, seed=1)))
    with products(spark):
        inner = stored(bars_frame(spark, random_walk(9, seed=1)))
        assert inner.count() == 9
        folder = inner.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert not Path(folder).exists() and before.count() == 5


def test_a_cluster_needs_a_folder_with_its_file_system():
    class Session:
        """A session on a cluster, as far as the folder asks."""

        def __init__(self, base, master="spark://host:7077"):
            self.conf = {"spark.checkpoint.dir": base} if base else {}
            self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-x"})

    for base in (None, "/tmp/x"):
        for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
            with pytest.raises(ValueError):
                shared_folder(Session(base, master))
    assert shared_folder(Session("hdfs://host/x")).startswith("hdfs://host/x/barloom-")


def test_merge_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 2), (3, 3)], "a int, b int")
    got = {r.merge: r for r in merge_null_audit(df, {"x": "a", "y": "b"}).collect()}
    assert (got["x"].nulls, got["x"].flagged) == (0, False)
    assert (got["y"].total, got["y"].nulls, got["y"].flagged) == (3, 1, True)


def test_report(spark, tmp_path):
    names = (
        "profit_net dd win_rate sharpe pips_sharpe total_return_pct max_dd_pct bh_pips"
        " bh_return_pct alpha_pips alpha_return_pct expectancy signal_ratio"
    ).split()
    schema = "symbol string, year int, trades bigint, n_signals bigint, " + ", ".join(f"{n} double" for n in names)
    row = ("X", 2024, 764, 1998, 7454.4, -52.4, 63.35, 11.58, 11.58, 74.54, -0.52, -691.2, -6.91, 8145.6, 81.46, 9.757, 2.615)
    metrics = spark.createDataFrame([row], schema)
    reports = performance_report(metrics, Barriers(), Account(), 0.45, "V9", "Some notes")
    text = reports.first().report
    for part in (
        "**Year:** 2024",
        "**Version:** V9",
        "TP=20p / SL=10p / Window=24 bars / Threshold=0.45 / Commission=0p / Capital=10000",
        "| Trades | 764 |",
        "| Net result | 7454.4 pips (+74.54%) |",
        "| Signals / trades | 1998 / 764 (x2.62) |",
        "| Buy and hold | -691.2 pips (-6.91%) |",
        "Some notes",
    ):
        assert part in text
    path = str(tmp_path / "reports")
    write_reports(reports, path)
    assert spark.read.text(path).where("value like '%764%'").count() == 2


def test_files_in_nested_folders_are_read_and_checked(spark, tmp_path):
    rows = "".join(f"2024.01.0{d} 00:00:00\t1\t2\t0.5\t1.5\t10\t3\n" for d in range(1, 6))
    for place in ("AAA_H1.csv", "2024/BBB_H1.csv", "2024/part/CCC_H4.csv"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(rows)
    raw, files = read_raw_bars(spark, str(tmp_path)), checked_files(spark, str(tmp_path))
    assert raw.groupBy("symbol").count().orderBy("symbol").collect() == [("AAA", 5), ("BBB", 5), ("CCC", 5)]
    report = {symbol: (n, bad, un) for symbol, n, bad, un in (
        (r.file.rsplit("/", 1)[1][:3], r["rows"], r.rejected, r.unreadable) for r in rejected_rows(raw, files).collect()
    )}
    assert report == {s: (5, 0, False) for s in ("AAA", "BBB", "CCC")}


def test_one_part_of_a_product_is_replaced(spark, tmp_path):
    path = str(tmp_path / "product")
    rows = spark.range(300).select((F.col("id") % 3 + 2020).alias("year"), "id", F.lit(0).alias("v"))
    write_table(rows, path, ["year"], ["id"])

    def files(year):
        return {f.name: f.stat().st_mtime_ns for f in (tmp_path / "product" / f"year={year}").glob("*.parquet")}

    before = {y: files(y) for y in (2020, 2021, 2022)}
    later = rows.where("year = 2021 and id < 150").withColumn("v", F.lit(1))
    write_table(later, path, ["year"], ["id"], replace="parts")
    assert {y: files(y) for y in (2020, 2022)} == {y: before[y] for y in (2020, 2022)}
    assert not set(files(2021)) & set(before[2021])

    def sums():
        return {r.year: (r.n, r.v) for r in spark.read.parquet(path).groupBy("year").agg(F.count("id").alias("n"), F.sum("v").alias("v")).collect()}

    held = {2020: (100, 0), 2021: (50, 50), 2022: (100, 0)}
    assert sums() == held
    broken = rows.where("year = 2020").repartition(4).withColumn(
        "v", F.when(F.col("id") == 297, F.raise_error(F.lit("lost")).cast("int")).otherwise(9)
    )
    with pytest.raises(Exception, match="lost"):
        write_table(broken, path, ["year"], replace="parts")
    assert sums() == held
    with pytest.raises(ValueError):
        write_table(rows, path, replace="parts")


def test_a_cluster_without_such_a_folder_uses_the_warehouse():
    class Session:
        def __init__(self, base, warehouse, master):
            self.conf = {"spark.sql.warehouse.dir": warehouse} | ({"spark.checkpoint.dir": base} if base else {})
            self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-y"})

    for base in (None, "/tmp/x"):
        for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
            for warehouse in ("hdfs://host/tables", "file:/mnt/tables/"):
                found = shared_folder(Session(base, warehouse, master))
                assert found.startswith(f"{warehouse.rstrip('/')}/barloom-")
        default = "file:/home/me/spark-warehouse"
        assert shared_folder(Session(base, default, "local-cluster[2,1,1024]")).startswith(f"{default}/barloom-")
        with pytest.raises(ValueError):
            shared_folder(Session(base, default, "yarn"))
    kept = Session("s3a://bucket/x", "hdfs://host/tables", "yarn")
    assert shared_folder(kept).startswith("s3a://bucket/x/barloom-")
