import math
import random

from collections import Counter

import numpy as np

from barloom.llm import fingerprints as fp
from brute import sha

RULE = fp.DigestRule()


def prose(seed, n):
    dealt = random.Random(seed)
    return " ".join("".join(dealt.choices("abcdefghij", k=dealt.randint(2, 9))) for _ in range(n))


def test_levels_follow_the_entropy_of_the_window():
    raw = (prose(1, 40) + "a" * 100 + "ab" * 60).encode()
    levels = fp.window_levels(np.frombuffer(raw, dtype=np.uint8), RULE)
    w = RULE.window
    most = sum(round(65536 * (c * math.log2(c) - ((c - 1) * math.log2(c - 1) if c > 1 else 0))) for c in range(2, w + 1))
    for end in range(w - 1, len(raw), 7):
        counts = Counter(raw[end - w + 1 : end + 1]).values()
        total = sum(65536 * c * math.log2(c) for c in counts)
        assert abs(levels[end] - total * RULE.levels / (most + 1)) <= 1.01


def test_selected_windows_win_their_contests():
    raw = [prose(2, 60).encode(), b"", b"short", prose(3, 9).encode(), b"z" * 200]
    sizes = np.array([len(r) for r in raw])
    x = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ranks = np.arange(RULE.levels)[::-1][fp.window_levels(x, RULE)]
    want, start = [], 0
    for size in sizes.tolist():
        ends = list(range(start + RULE.window - 1, start + size))
        won = Counter()
        for i in range(len(ends) - RULE.run + 1):
            won[min(ends[i : i + RULE.run], key=lambda e: (ranks[e], e))] += 1
        often = [e for e in ends if won[e] >= RULE.wins]
        if ends and not often:
            often = [max(ends, key=lambda e: (won[e], -e))] if won else [min(ends, key=lambda e: (ranks[e], e))]
        want += often
        start += size
    assert fp.selected(ranks, sizes, RULE).tolist() == want


def test_a_fingerprint_does_not_depend_on_its_neighbours():
    ranks = np.arange(RULE.levels)
    texts = [prose(i, n).encode() for i, n in enumerate((0, 1, 30, 400, 2000))]
    together = fp.fingerprints(texts, ranks, RULE)
    for text, found in zip(texts, together):
        assert np.array_equal(fp.fingerprints([b"x" * 99, text], ranks, RULE)[1], found)


def test_likeness():
    ranks = np.arange(RULE.levels)
    a, b = prose(1, 500), prose(2, 500)
    halves = a[: len(a) // 2] + b[len(b) // 2 :]
    x, y, z, none = fp.fingerprints([t.encode() for t in (a, b, halves, "")], ranks, RULE)
    assert fp.likeness(x, x) == fp.likeness(none, none) == 1
    assert fp.likeness(x, none) == 0
    assert fp.likeness(x, y) < 0.1 < 0.3 < fp.likeness(x, z) < 0.8
    assert fp.likeness(x, z) == fp.likeness(z, x)


def brute(docs, ranks):
    """Rows of (doc_id, text) in order of id, largest first, each with the next one."""
    out = []
    for (d, t), (_, following) in zip(docs, docs[1:] + docs[:1]):
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        x, y, z = (fp.fingerprints([s.encode()], ranks, RULE)[0] for s in (t, changed, following))
        out.append((d, len(t), sha(changed), x.tobytes().hex(), y.tobytes().hex(), fp.likeness(x, y), fp.likeness(x, z)))
    return out


def test_whole_table_matches_brute_force(sf_small):
    docs = sf_small("documents")
    rule = fp.DigestRule(rows=16)
    ranks = fp.entropy_ranks(docs, rule)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    found = fp.fingerprint_report(docs, rule).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows, ranks))
    same = {}
    for r, (_, text) in zip(sorted(found, key=lambda r: -r.doc_id), rows):
        assert same.setdefault(text, r.fingerprint) == r.fingerprint


def test_odd_rows(spark, odd_docs, no_docs):
    found = fp.fingerprint_report(odd_docs).collect()
    assert len(found) == odd_docs.count()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect() if r.doc_id}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.n_chars == len(texts.get(r.doc_id, "no id but a text with some words in it" if r.n_chars else ""))
    assert fp.fingerprint_report(no_docs).count() == 0
    one = spark.createDataFrame([(5, "only one text " * 9)], "doc_id long, text string")
    assert [(r.near_next, r.n_chars) for r in fp.fingerprint_report(one).collect()] == [(1.0, 126)]


def test_stretches_change_nothing(sf_small):
    """Few long stretches, and bounds from a few sampled ids, give the same rows."""
    docs = sf_small("documents")
    want = sorted(map(tuple, fp.fingerprint_report(docs).collect()))
    for rule in (fp.DigestRule(rows=16, stretches=3), fp.DigestRule(rows=16, ids_for_cut=1)):
        assert sorted(map(tuple, fp.fingerprint_report(docs, rule).collect())) == want
