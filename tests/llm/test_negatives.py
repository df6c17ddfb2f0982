import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from barloom.llm import negatives as ng

ROWS = "vec_id long, embedding array<float>, label int"
ANCHORS = "vec_id % 100 = 0"


def plain(rows, rule=ng.NegativeRule(), anchor=lambda i: i % 100 == 0):
    taken = {}
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        own = (label, [math.floor(rule.scale * float(np.float32(x))) for x in vec])
        taken[i] = min(taken.get(i, own), own)

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a, (label, vec) in taken.items():
        if not anchor(a):
            continue
        scored = sorted((-score(vec, v), i) for i, (_, v) in taken.items() if i != a)
        same = [(i, -s) for s, i in scored if taken[i][0] == label][: rule.positives]
        for p, ps in same:
            near = [(i, -s) for s, i in scored if taken[i][0] != label and rule.low * ps <= -100 * s <= rule.high * ps]
            out += [(a, p, k + 1, i, ps, ns) for k, (i, ns) in enumerate(near[: rule.negatives])]
    return sorted(out)


def found(spark, rows, rule=ng.NegativeRule()):
    table = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("label_", "block", "group", "vec", "own")})
    return sorted(map(tuple, ng.hard_negatives(table.repartition(3), F.expr(ANCHORS), rule).collect()))


def vectors(seed, n, width=12, grid=4):
    """Coarse components, so that many scores tie."""
    dealt = random.Random(seed)
    return [[dealt.randint(-grid, grid) / grid for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("block", [4096, 37])
def test_matches_brute_force(spark, block):
    rows = [(i * 5, v, i % 3) for i, v in enumerate(vectors(1, 260))]
    rule = ng.NegativeRule(block=block)
    want = plain(rows, rule)
    assert len(want) > 300
    assert found(spark, rows, rule) == want


def test_rows_that_take_no_part(spark):
    rows = [(i * 10, v, i % 2) for i, v in enumerate(vectors(2, 60))]
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, 1), (1, [nan] * 12, 1), (2, [1.0, inf], 0), (3, [None, 1.0], 1), (4, [1.0] * 12, None)]
    rows += [(None, [1.0] * 12, 0), (5, [], 1), (6, [1.0, 1.0], 0), rows[7], rows[0], (700, [0.0] * 12, 0), (200, [1.0] * 12, 9)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:0]) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_components_keep_exact_scores(spark):
    dealt = random.Random(5)
    rows = [(i * 20, [dealt.uniform(-9e4, 9e4) for _ in range(6)], i % 2) for i in range(50)]
    assert found(spark, rows) == plain(rows)
    small = [(i, [x / 1e5 for x in v], k) for i, v, k in rows]
    assert found(spark, small) == plain(small)


@pytest.mark.parametrize("most", [3, 500, 2**20, 2**30])
def test_packed_scores_are_products(most):
    dealt = np.random.default_rng(most)
    a, b = dealt.integers(-most, most, (40, 9)), dealt.integers(-most, most // 2 + 1, (5, 9))
    packed = ng.Packed.of(a, b)
    assert packed.field == (4 if most <= 500 else 8 if most <= 2**20 else 16)
    for anchor in b:
        assert packed.scores(anchor).tolist() == [sum(x * y for x, y in zip(r, anchor.tolist())) for r in a.tolist()]
