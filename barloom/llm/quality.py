"""Quality by weak supervision.

Simple rules vote good, bad or not at all on every text. How far each can be trusted is estimated
without labels: expectation-maximisation over the patterns of votes finds the share of good texts
and, for each rule, how it votes on good and on bad ones. A text is kept if its posterior
probability of being good is one half or more, so no single rule decides.

Only the counts of the patterns are collected, 3 ** rules of them at most.
"""

from __future__ import annotations

import re

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WordHashes, sequence, stored, text_chunks, texts_of, word_arrays

SYMBOLS = "#*$%&|<>"
WORD = re.compile(r"[^\x20\x09-\x0D]")
#: Two or more equal signs in a row that close a word: ``and&&&``, ``BUT!!``.
DOUBLE_SIGN = re.compile(r"([^\w\s])\1+(?=\s|$)")
#: A word without letters or digits.
BARE_SIGN = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
#: A word that closes a sentence or a part of one.
ENDING = re.compile(r"\w[.,;:?!](?=\s|$)")
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
    "n_digits",
    "n_stutters",
    "n_double_signs",
    "n_bare_signs",
    "n_ends",
)


@dataclass(frozen=True)
class EmRule:
    """``window`` words make a window; ``rounds`` at most; ``prior``: how many votes
    a rule is credited with beforehand, cast as in ``usual``. Rules start as right in ``trust_bad`` of their bad votes and
    ``trust_good`` of their good ones: a fault found says more than one fault not found."""

    window: int = 5
    rounds: int = 200
    prior: float = 10.0
    trust_bad: float = 0.95
    trust_good: float = 0.55
    #: Shares of the votes bad, none and good on bad texts and on good ones.
    usual: tuple[tuple[float, float, float], ...] = ((0.3, 0.2, 0.5), (0.02, 0.08, 0.9))


def repeated_window_words(hashes: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Per text, the words that lie in windows found twice or more in it.

    Windows are told apart exactly: word numbers are joined pairwise into numbers of longer runs.
    """
    owner, _ = sequence(counts)
    total = len(hashes) - window + 1
    out = np.zeros(len(counts), dtype=np.int64)
    if total <= 0:
        return out
    _, names = np.unique(hashes, return_inverse=True)
    runs, size = names.astype(np.int64), 1
    while size < window:
        step = min(size, window - size)
        pairs = runs[: len(runs) - step] * (int(runs.max()) + 1) + runs[step:]
        _, runs = np.unique(pairs, return_inverse=True)
        size += step
    inside = np.flatnonzero(owner[:total] == owner[window - 1 :])
    keys = owner[inside] * (int(runs.max()) + 1) + runs[inside]
    _, back, seen = np.unique(keys, return_inverse=True, return_counts=True)
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    twice = inside[seen[back] > 1]
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=len(counts))


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines), len(lines) - len(set(lines))


def stutters(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the words equal to the word before."""
    owner, _ = sequence(counts)
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][same], minlength=len(counts))


def characters(text: str) -> tuple[int, int, int]:
    """Upper-case letters, all letters, and digits."""
    counts = Counter(text).items()
    return (
        sum(n for c, n in counts if c.isupper()),
        sum(n for c, n in counts if c.isalpha()),
        sum(n for c, n in counts if c.isdigit()),
    )


def measures(docs: DataFrame, rule: EmRule) -> DataFrame:
    """``doc_id`` and the measures of each row's whole text."""
    names = ["doc_id", *MEASURES]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in text_chunks(batches):
            texts = texts_of(batch)
            raw = [t.encode() for t in texts]
            hashes, counts = word_arrays(raw, known)
            lines = [duplicate_lines(t) for t in texts]
            cases = [characters(t) for t in texts]
            columns = [
                counts,
                [len(t) - sum(map(t.count, " \t\n\v\f\r")) for t in texts],
                [sum(map(t.count, SYMBOLS)) for t in texts],
                [d for _, d in lines],
                repeated_window_words(hashes, counts, rule.window),
                [n for n, _ in lines],
                *zip(*cases),
                stutters(hashes, counts),
                [len(DOUBLE_SIGN.findall(t)) for t in texts],
                [len(BARE_SIGN.findall(t)) for t in texts],
                [len(ENDING.findall(t)) for t in texts],
            ]
            arrays = [pa.array(np.asarray(c, dtype=np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    )


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, on the columns of ``measures``: 1 for good, -1 for bad, 0 if a rule abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    some = F.greatest(F.col("n_letters"), F.lit(1))
    length, chars = F.col("n_words"), F.col("word_chars") / words
    symbols, signs = F.col("n_symbols") / words, F.col("n_double_signs") / words
    chars_all = F.greatest(F.col("word_chars"), F.lit(1))
    stutter = F.col("n_stutters") / words
    bare, ends = F.col("n_bare_signs") / words, F.col("n_ends") / words
    repeats, copies = F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines
    upper, share = F.col("n_upper") / some, (F.col("n_letters") + F.col("n_digits")) / chars_all
    return {
        "length": vote(length < 10, length >= 30),
        "word_length": vote((chars < 2.5) | (chars > 12), (chars >= 3.5) & (chars <= 9)),
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "double_signs": vote(signs > 0.1, signs < 0.02),
        "bare_signs": vote(bare > 0.1, bare < 0.02),
        "endings": vote(ends < 0.01, (ends > 0.03) & (ends < 0.5)),
        "repeats": vote(repeats > 0.2, repeats < 0.05),
        "stutters": vote(stutter > 0.2, stutter < 0.05),
        "copied_lines": vote(copies > 0.4, copies < 0.2),
        "upper_case": vote(upper > 0.3, upper < 0.12),
        "letters": vote(share < 0.7, share > 0.85),
    }


def accuracies(patterns: np.ndarray, counts: np.ndarray, rule: EmRule) -> tuple[float, np.ndarray]:
    """Share of good texts and, by class (bad, good), rule and vote (-1, 0, 1), the vote's probability.

    ``patterns`` has a row per pattern of votes and ``counts`` how many texts have it.
    """
    n_rules = patterns.shape[1]
    kinds = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    # Start: a text is good as far as the votes that its rules cast say so.
    weak, strong = (np.log(t / (1 - t)) for t in (rule.trust_good, rule.trust_bad))
    lean = weak * (patterns == 1).sum(axis=1) - strong * (patterns == -1).sum(axis=1)
    good = 1 / (1 + np.exp(-np.clip(lean, -30, 30)))
    usual = rule.prior * np.array(rule.usual)[:, None, :]
    total = max(float(counts.sum()), 1.0)
    share, table = 0.5, np.full((2, n_rules, 3), 1 / 3)
    for _ in range(rule.rounds):
        weights = np.stack([counts * (1 - good), counts * good])
        table = np.einsum("cp,prk->crk", weights, kinds) + usual
        table /= table.sum(axis=2, keepdims=True)
        share = (weights[1].sum() + 1) / (total + 2)
        now = posterior(patterns, share, table)
        done = np.abs(now - good).max(initial=0.0) < 1e-9
        good = now
        if done:
            break
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability that a text with each pattern of votes is good. An abstention says nothing."""
    bad, good = (
        np.log(table[c])[np.arange(patterns.shape[1])[None, :], patterns + 1] for c in (0, 1)
    )
    cast = np.where(patterns != 0, good - bad, 0.0).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(cast + np.log(share / (1 - share)), -30, 30)))


def judged(rows: DataFrame, rules: dict[str, Column], rule: EmRule = EmRule()) -> DataFrame:
    """``rows`` (a written table) with ``quality``, the posterior probability of being good."""
    names = [f"__vote_{name}" for name in rules]
    voted = rows.withColumns(dict(zip(names, rules.values())))
    found = voted.groupBy(*names).count().collect()
    patterns = np.array([[r[n] for n in names] for r in found], dtype=np.int64).reshape(-1, len(names))
    counts = np.array([r["count"] for r in found], dtype=float)
    good = posterior(patterns, *accuracies(patterns, counts, rule))
    fields = ", ".join(f"`{n}` int" for n in names)
    table = [(*map(int, p), float(round(g, 9))) for p, g in zip(patterns, good)]
    table = rows.sparkSession.createDataFrame(table, f"{fields}, quality double")
    return voted.join(F.broadcast(table), names).drop(*names)


def quality_report(docs: DataFrame, rule: EmRule = EmRule()) -> DataFrame:
    """Measures, base verdict and quality of every row.

    A null or empty text has no words and fails the base rule (fewer than 10 words, or more than a
    fifth of them in repeated windows). Rows stand alone: repeated rows repeat their results.
    """
    rows = judged(stored(measures(docs, rule)), votes(), rule)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("quality") >= 0.5)).alias("kept"),
        "quality",
    )
