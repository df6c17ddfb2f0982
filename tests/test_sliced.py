import random
import re
from datetime import timedelta

import pytest
from helpers import START

from barloom.config import Layout
from barloom.operators.asof import RightSide, asof_backward
from barloom.operators.sliced import asof_sliced, drop_sliced, read_sliced, write_sliced

SLICES = Layout(slice_seconds=50 * 3_600)


def frame(spark, rows, column):
    data = [(s, START + timedelta(hours=t), v) for s, t, v in rows]
    return spark.createDataFrame(data, f"symbol string, time timestamp_ntz, {column} int")


def series(seed, symbols, n):
    rng = random.Random(seed)
    return [(s, t, t * 10 + seed) for s in symbols for t in sorted(rng.sample(range(2_000), n))]


@pytest.fixture
def tables(spark):
    left = frame(spark, series(1, "XYZ", 200), "a")
    rights = [frame(spark, series(n, "XZ", 30), f"v{n}") for n in (2, 3)]
    yield left, rights
    for name in ("t_left", "t_right0", "t_right1"):
        drop_sliced(spark, name)


def stored_sides(left, rights, lag=0.0):
    stored = write_sliced(left, "t_left", 4, layout=SLICES)
    sides = [
        (write_sliced(r, f"t_right{n}", 4, layout=SLICES, lag=lag), (r.columns[-1],))
        for n, r in enumerate(rights)
    ]
    return stored, sides


@pytest.mark.parametrize("lag", [0.0, 8.0])
def test_same_as_the_join_of_plain_tables(spark, tables, lag):
    left, rights = tables
    got = asof_sliced(*stored_sides(left, rights, lag))
    want = asof_backward(left, [RightSide(r, (r.columns[-1],), lag) for r in rights], ["symbol"], SLICES)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_bar_is_shuffled(spark, tables):
    joined = asof_sliced(*stored_sides(*tables))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # The path from the root to a scan: the lines above it that lie less deep.
    above: list[tuple[int, str]] = []
    scans = []
    for line in plan.splitlines():
        depth = len(re.match(r"[ :+\-]*", line).group())
        above = [a for a in above if a[0] < depth] + [(depth, line)]
        if "FileScan" in line and "_ends" not in line:
            scans.append([a[1] for a in above])
    assert len(scans) == 3
    assert not [line for path in scans for line in path if "Exchange" in line]


def test_a_stored_table_is_found_again_and_replaced(spark, tables):
    left, rights = tables
    stored, sides = stored_sides(left, rights)
    again = read_sliced(spark, "t_left")
    assert (again.keys, again.seconds, again.buckets) == (("symbol",), SLICES.slice_seconds, 4)
    assert asof_sliced(again, sides).count() == left.count()
    fewer = write_sliced(left.where("a > 9000"), "t_left", 4, layout=SLICES)
    assert asof_sliced(fewer, sides).count() == left.where("a > 9000").count()


def test_an_empty_right_table_matches_nothing(spark, tables):
    left, rights = tables
    stored, sides = stored_sides(left, [rights[0], rights[1].limit(0)])
    got = asof_sliced(stored, sides)
    assert got.count() == left.count() and got.where("v3 is not null").count() == 0
    assert got.where("v2 is not null").count() > 0


def test_tables_of_another_layout_are_refused(spark, tables):
    left, rights = tables
    stored, _ = stored_sides(left, rights)
    other = write_sliced(rights[0], "t_right0", 8, layout=SLICES)
    with pytest.raises(ValueError):
        asof_sliced(stored, [(other, ("v2",))])
