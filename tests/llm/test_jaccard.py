import random

import numpy as np
import pytest

from barloom.llm import jaccard
from barloom.llm.graph import components
from brute import near_components

NO_ID = -(10**9)


def families(seed, n=160, percent_changed=(0, 12)):
    """Texts in families: copies of a few bases with some words changed, and quotes of a passage."""
    dealt = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    bases = [dealt.choices(vocabulary, k=dealt.randint(3, 160)) for _ in range(12)]
    passage = dealt.choices(vocabulary, k=40)
    out = []
    for _ in range(n):
        words = list(dealt.choice(bases))
        for _ in range(len(words) * dealt.randint(*percent_changed) // 100):
            words[dealt.randrange(len(words))] = dealt.choice(vocabulary)
        if dealt.random() < 0.3:
            words = words[: len(words) // 2] + passage + words[len(words) // 2 :]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_matches_brute_force(spark, words, percent):
    docs = list(enumerate(families(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rule = jaccard.JaccardRule(words, percent, block=8)
    found = {r[0]: (r[1], r[2]) for r in jaccard.component_report(table, rule).collect()}
    assert found == near_components(docs, words, percent)
    assert len({c for _, c in found.values()}) < len(docs)


def test_odd_rows(odd_docs, no_docs):
    rule = jaccard.JaccardRule(3, 90)
    rows = odd_docs.select("doc_id", "text").distinct().collect()
    keyed = [(NO_ID - i if r.doc_id is None else r.doc_id, r.text) for i, r in enumerate(rows)]
    want = near_components(keyed, 3, 90)
    want = [tuple(None if x is not None and x <= NO_ID else x for x in (k, n, c)) for k, (n, c) in want.items()]
    found = {tuple(r) for r in jaccard.component_report(odd_docs, rule).collect()}
    assert sorted(found, key=str) == sorted(want, key=str)
    assert jaccard.component_report(odd_docs, rule).count() == odd_docs.count()
    assert jaccard.component_report(no_docs, rule).count() == 0


def test_one_row_of_each_component_stays(odd_docs, no_docs):
    rule = jaccard.JaccardRule()
    kept = jaccard.keep_one(odd_docs, rule)
    assert kept.columns == odd_docs.columns
    found = jaccard.component_report(odd_docs, rule).distinct().collect()
    heads = [r.doc_id for r in found if r.doc_id == r.component_id]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d in heads)
    assert jaccard.keep_one(no_docs, rule).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = ("p q r s t u v w x y " * 3).split(), [f"k{i}" for i in range(30)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (7, " ".join(a)), (7, " ".join(b))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in jaccard.component_report(table, jaccard.JaccardRule()).collect()}
    assert found == {(1, 1), (2, 1), (7, 1)}


def test_bitmaps_bound_the_difference():
    dealt = np.random.default_rng(5)
    for _ in range(200):
        n, m = dealt.integers(1, 900, 2)
        a, b = (np.unique(dealt.integers(0, 1200, k).astype(np.uint64)) for k in (n, m))
        x, y = (jaccard.bitmaps(s, np.array([len(s)]))[0] for s in (a, b))
        assert jaccard.differing(x, y) <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(9, k) for k in range(20, 40)] + [(3, 9)]
    table = spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")
    found = dict(map(tuple, components(table).collect()))
    assert found == {**{i: 100 for i in range(100, 141)}, **{k: 3 for k in [3, 9, *range(20, 40)]}}
    assert components(table.limit(0)).count() == 0
