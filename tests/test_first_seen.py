import random

import pytest

from barloom.operators.cleaning import clean_bars
from barloom.operators.first_seen import clean_delivery, seen_keys
from barloom.session import shared_folder

RAW = "symbol string, timeframe string, time string, " + ", ".join(
    f"{c} string" for c in ("open", "high", "low", "close", "volume", "spread")
) + ", line long"


def raw_rows(spark, rows):
    """(symbol, day of 2024 or text, price or text) with the line as the place in the list."""
    data = []
    for line, (symbol, day, price) in rows:
        time = day if isinstance(day, str) else f"2024-{1 + day // 28:02d}-{1 + day % 28:02d} 00:00:00"
        data.append((symbol, "D1", time, *[str(price)] * 6, line))
    return spark.createDataFrame(data, RAW)


def cleaned(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_deliveries_in_turn_equal_one_run(spark, seed):
    rng = random.Random(seed)
    rows = [
        (line, (rng.choice("XY"), rng.choice([rng.randrange(300), "no time"]) if line % 9 == 0 else rng.randrange(300),
                rng.choice([1.5, 2.5, "n/a"])))
        for line in range(900)
    ]
    index, got = shared_folder(spark), []
    for n, (start, end) in enumerate([(0, 200), (200, 210), (210, 900)]):
        got += cleaned(clean_delivery(raw_rows(spark, rows[start:end]), index, f"d{n}", ["line"]))
    assert sorted(got) == cleaned(clean_bars(raw_rows(spark, rows), ["line"]))


def test_a_time_first_seen_incomplete_stays_lost(spark):
    index = shared_folder(spark)
    first = clean_delivery(raw_rows(spark, [(0, ("X", 3, "n/a"))]), index, "a", ["line"])
    later = clean_delivery(raw_rows(spark, [(1, ("X", 3, 1.0)), (2, ("X", 4, 2.0))]), index, "b", ["line"])
    assert first.count() == 0
    assert [r.open for r in later.collect()] == [2.0]


def test_a_repeated_delivery_gives_its_bars_again(spark):
    index, rows = shared_folder(spark), [(0, ("X", 3, 1.0)), (1, ("Y", 200, 2.0))]
    first = cleaned(clean_delivery(raw_rows(spark, rows), index, "a", ["line"]))
    assert cleaned(clean_delivery(raw_rows(spark, rows), index, "a", ["line"])) == first
    assert seen_keys(spark, index).count() == 2
    assert cleaned(clean_delivery(raw_rows(spark, rows), index, "b", ["line"])) == []


def test_an_empty_delivery_changes_nothing(spark):
    index = shared_folder(spark)
    clean_delivery(raw_rows(spark, [(0, ("X", 3, 1.0))]), index, "a", ["line"])
    assert clean_delivery(raw_rows(spark, []), index, "b", ["line"]).count() == 0
    assert seen_keys(spark, index).count() == 1


def test_slices_that_a_delivery_does_not_touch_are_not_read(spark, tmp_path):
    index = str(tmp_path / "index")
    clean_delivery(raw_rows(spark, [(0, ("X", 3, 1.0)), (1, ("X", 200, 1.0))]), index, "a", ["line"])
    folders = sorted((tmp_path / "index").glob("_slice=*"))
    for file in folders[0].rglob("*.parquet"):  # the slice of day 3 cannot be read any more
        file.write_bytes(b"broken")
    later = clean_delivery(raw_rows(spark, [(2, ("X", 200, 9.0)), (3, ("X", 201, 2.0))]), index, "b", ["line"])
    assert [r.open for r in later.collect()] == [2.0]
