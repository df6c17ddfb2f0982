import random

import pytest

from barloom.llm import substrings
from brute import sha, window_dedup


def overlapping(seed, n=60):
    dealt = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30)]
    shared = [dealt.choices(vocabulary, k=dealt.randint(5, 90)) for _ in range(6)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(dealt.randint(0, 4)):
            words += dealt.choice(shared) if dealt.random() < 0.6 else dealt.choices(vocabulary, k=25)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("length", [2, 10, 50])
def test_matches_brute_force(spark, length):
    docs = list(enumerate(overlapping(length)))
    random.Random(1).shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = substrings.window_digests(table, substrings.WindowRule(length)).collect()
    want = [(d, n, k, sha(t)) for d, n, k, t in window_dedup(docs, length)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert sum(r.n_removed for r in found) > 0


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    keyed = [(-1000 - i if d is None else d, t) for i, (d, t) in enumerate(rows)]
    want = [(d if d > -1000 else None, n, k, sha(t)) for d, n, k, t in window_dedup(keyed)]
    found = [tuple(r) for r in substrings.window_digests(odd_docs).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert substrings.window_digests(no_docs).count() == 0


def test_repeats_within_a_document_stay(spark):
    table = spark.createDataFrame([(1, "a b " * 200), (2, "c " * 100)], "doc_id long, text string")
    assert [r.n_removed for r in substrings.window_digests(table).collect()] == [0, 0]


def test_levels_double_until_no_window_repeats(spark):
    docs = list(enumerate(overlapping(3, n=40)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {(r.doc, r.start, r.length) for r in substrings.repeat_levels(table, substrings.WindowRule(10)).collect()}
    first = {}
    for d, t in docs:  # copies of a word sequence are one document
        first.setdefault(tuple(t.split()), d)
    want, length = set(), 10
    while True:
        holders = {}
        for ws, d in first.items():
            for i in range(len(ws) - length + 1):
                holders.setdefault(ws[i : i + length], set()).add((d, i))
        level = {(d, i, length) for at in holders.values() if len({d for d, _ in at}) > 1 for d, i in at}
        if not level:
            break
        want, length = want | level, 2 * length
    assert length >= 40 and found == want
    assert substrings.repeat_levels(table.limit(0)).count() == 0
