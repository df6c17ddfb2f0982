import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from barloom.llm import graph
from barloom.llm import neighbours as nb

ROWS = "vec_id long, embedding array<double>"


def blob(dealt, centre, n, spread):
    return [(centre + spread * dealt.standard_normal(len(centre))).tolist() for _ in range(n)]


def plain(rows, threshold=0.95):
    """(vec_id, links, component, kept) by comparing every two rows."""
    width = max((len(v) for _, v in rows if v), default=0)
    units = []
    for i, v in rows:
        fit = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        whole = np.array(v + [0.0] * (width - len(v))) / max(map(abs, v)) if fit else None
        units.append(whole / np.linalg.norm(whole) if fit else None)
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and units[a] @ units[b] >= threshold:
                links[a] += 1
                links[b] += 1
                top[root(a)] = root(b)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[root(k)] = min(names.get(root(k), i), i)
    return sorted(((i, links[k], c, i == c) for k, (i, _) in enumerate(rows) for c in [names.get(root(k))]), key=str)


def found(spark, rows, rule=nb.NeighbourRule()):
    table = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("node", "n", "h1", "family", "label")})
    return sorted(map(tuple, nb.near_duplicates(table.repartition(3), rule).collect()), key=str)


def test_families_pairs_and_odd_rows(spark):
    dealt = np.random.default_rng(4)
    centres = dealt.standard_normal((40, 24))
    vectors = [v for c in centres for v in blob(dealt, c, 3, 0.12)] + blob(dealt, centres[0], 90, 0.1)
    vectors += [vectors[5]] * 30 + [(2 * np.array(vectors[5])).tolist()] + dealt.standard_normal((300, 24)).tolist()
    rows = [(int(k) * 3, v) for k, v in zip(dealt.permutation(len(vectors)), vectors)]
    nan = float("nan")
    rows += [(None, vectors[5]), (7, None), (10, []), (13, [0.0] * 24), (16, [nan] * 24), (19, [None] + [1.0] * 23)]
    rows += [(22, [1.0]), (25, [3.0, 0.0]), (28, [-0.0, 0.0]), (31, [1e-200, 1e-200]), (34, [1e200, 1e200]), (37, [float("inf")])]
    rows += [rows[11], (0, vectors[200])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:0]) == []
    assert found(spark, [(1, [1.0, 0.0])]) == [(1, 0, 1, True)]


def test_saturated_lists_are_enlarged(spark):
    """Families larger than any list, one of them with pairs on either side of the threshold, and two
    that only some of their members link."""
    dealt = np.random.default_rng(9)
    a = dealt.standard_normal(16)
    b = dealt.standard_normal(16)
    side = b - a * (a @ b) / (a @ a)
    side *= np.linalg.norm(a) / np.linalg.norm(side)
    near = a * math.cos(0.45) + side * math.sin(0.45)
    vectors = blob(dealt, a, 120, 0.08) + blob(dealt, near, 120, 0.08) + blob(dealt, b * 3, 150, 0.55)
    rows = [(int(k), v) for k, v in zip(dealt.permutation(len(vectors)), vectors)]
    want = plain(rows)
    assert len({w[1] for w in want}) > 20
    assert found(spark, rows, nb.NeighbourRule(neighbours=4, tile=32)) == want


def test_the_audit_asks_for_more(spark, monkeypatch):
    dealt = np.random.default_rng(2)
    vectors = [v for c in dealt.standard_normal((60, 8)) for v in blob(dealt, c, 4, 0.02)]
    asked = []
    real = nb.audited
    monkeypatch.setattr(nb, "audited", lambda *a: (asked.append(real(*a)), (0, 1) if len(asked) < 2 else asked[-1])[1])
    rows = list(enumerate(vectors))
    assert found(spark, rows, nb.NeighbourRule(neighbours=2, orders=1, leaf=8, recall=1.0)) == plain(rows)
    assert len(asked) >= 2 and all(seen <= true for seen, true in asked)


@pytest.mark.parametrize("rising", [True, False])
def test_components_of_long_chains_take_few_tables(spark, monkeypatch, rising):
    n, tables = 1000, []
    names = list(range(n)) if rising else np.random.default_rng(1).permutation(n).tolist()
    real = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, *by: (tables.append(1), real(df, *by))[1])
    links = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long").repartition(4)
    rows = graph.components(links).collect()
    assert len(rows) == n and {r.component for r in rows} == {0}
    assert len(tables) <= (2 if rising else 5) * math.log2(n) + 6
