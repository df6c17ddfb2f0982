import pytest
from helpers import bars_frame, loop_labels, random_walk

from barloom.config import Barriers, Layout
from barloom.operators.labels import drop_unlabelled_tail, label_distribution, triple_barrier_label


def labels(spark, rows, barriers, layout=Layout()):
    df = triple_barrier_label(bars_frame(spark, rows), barriers, layout=layout)
    return [r.Target for r in df.orderBy("time").collect()]


def series(*bars):
    return [(i, *bar) for i, bar in enumerate(bars)]


FLAT = (100, 100, 100)


@pytest.mark.parametrize(
    "ahead, expected",
    [
        ([(120, 100, 110), FLAT], 1),  # target touched exactly
        ([(100, 80, 90), FLAT], -1),
        ([(120, 90, 100), FLAT], 0),  # target and stop on one bar: the stop wins
        ([(119, 91, 100), FLAT], 0),  # one short of every barrier
        ([(100, 90, 95), (120, 100, 110)], 0),  # stopped before the target
        ([(109, 91, 100), (120, 100, 110)], 1),
        ([FLAT, FLAT], 0),
    ],
)
def test_one_bar(spark, ahead, expected):
    rows = series(FLAT, *ahead)
    assert labels(spark, rows, Barriers(20, 10, 2, 1.0))[0] == expected


def test_both_sides_can_win_when_the_target_is_nearer(spark):
    rows = series(FLAT, (105, 95, 100), FLAT)
    assert labels(spark, rows, Barriers(5, 50, 2, 1.0))[0] == 0


def test_exactly_window_bars_left_still_labels(spark):
    rows = series(FLAT, FLAT, FLAT, FLAT)
    assert labels(spark, rows, Barriers(20, 10, 3, 1.0)) == [0, None, None, None]


def test_series_not_longer_than_the_window_has_no_label(spark):
    df = triple_barrier_label(bars_frame(spark, series(FLAT, FLAT)), Barriers(20, 10, 2, 1.0))
    assert drop_unlabelled_tail(df).count() == 0


@pytest.mark.parametrize("layout", [Layout(), Layout(86_400, 64, 16), Layout(3_600 * 7, 16, 4)])
def test_same_as_loop_however_the_series_is_cut(spark, layout):
    rows = random_walk(700, seed=3)
    expected = loop_labels(rows, 30, 15, 24)
    assert labels(spark, rows, Barriers(30, 15, 24, 1.0), layout) == expected
    assert {1, -1, 0} <= set(expected)


def test_distribution_adds_up(spark):
    df = triple_barrier_label(bars_frame(spark, random_walk(200, seed=1)), Barriers(20, 10, 5, 1.0))
    rows = label_distribution(df).collect()
    assert sum(r.n for r in rows) == 195
    assert abs(sum(r.share_pct for r in rows) - 100) < 0.05
