import random

import numpy as np

from barloom.llm import quality
from brute import base_quality


def test_measures_match_brute_force(spark, odd_docs, no_docs):
    dealt = random.Random(4)
    texts = ["\n".join(" ".join(dealt.choices("a b c d # | x% é".split(), k=dealt.randint(0, 9))) for _ in range(dealt.randint(0, 9))) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (table, odd_docs):
        found = quality.quality_report(docs).collect()
        want = [(r.doc_id, *base_quality(r.text)) for r in docs.select("doc_id", "text").collect()]
        assert sorted([tuple(r)[:6] for r in found], key=str) == sorted(want, key=str)
        for r in found:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.kept and r.base_failed)
            assert r.kept == (not r.base_failed and r.quality >= 0.5)
    assert quality.quality_report(no_docs).count() == 0


def test_em_finds_the_accuracies_behind_the_votes():
    dealt = np.random.default_rng(8)
    n, right = 60_000, np.array([0.95, 0.9, 0.8, 0.7, 0.55])
    good = dealt.random(n) < 0.8
    truth = np.where(good, 1, -1)[:, None]
    votes = np.where(dealt.random((n, 5)) < right, truth, -truth) * (dealt.random((n, 5)) < 0.9)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, table = quality.accuracies(patterns, counts.astype(float), quality.EmRule())
    cast = table[:, :, [0, 2]] / table[:, :, [0, 2]].sum(axis=2, keepdims=True)
    assert abs(share - 0.8) < 0.02
    assert np.abs(cast[1, :, 1] - right).max() < 0.03
    found = quality.posterior(patterns, share, table)[back.ravel()] >= 0.5
    # As good as a judge who knows the true accuracies.
    ideal = (votes * np.log(right / (1 - right))).sum(axis=1) + np.log(0.8 / 0.2) >= 0
    assert (found == good).mean() > (ideal == good).mean() - 0.002


def test_one_rule_alone_does_not_decide():
    """A rule that finds fault where all others find none is not trusted."""
    rng = np.random.default_rng(9)
    n = 20_000
    good = rng.random(n) < 0.9
    votes = np.where(good, 1, -1)[:, None] * np.ones((1, 6), dtype=int)
    votes[:, 5] = np.where(rng.random(n) < 0.5, -1, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table = quality.accuracies(patterns, counts.astype(float), quality.EmRule())
    p = quality.posterior(patterns, share, table)
    assert all((x >= 0.5) == (row[0] == 1) for x, row in zip(p, patterns))


def test_junk_goes_and_prose_stays(spark, sf_small):
    docs, labels = sf_small("documents"), sf_small("labels").withColumnRenamed("quality", "truth")
    rows = quality.quality_report(docs).join(labels, "doc_id").where("not base_failed").collect()
    bad, fine = [r.kept for r in rows if r.truth == 0], [r.kept for r in rows if r.truth == 1]
    assert sum(bad) <= 0.05 * len(bad) and sum(fine) >= 0.98 * len(fine)
