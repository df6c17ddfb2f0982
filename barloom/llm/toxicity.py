"""Toxicity by a weighted lexicon.

The lexicon is learned: words and beginnings of words, counted over labelled documents, whose
share of toxic documents stands out get their log odds as weight; longer forms of such a term
that stand in clean documents become exception phrases, which cancel the term where they match.
All terms are matched at once by an Aho-Corasick automaton over the folded text, and the summed
weight is normalised by the length of the text before a logistic curve turns it into a score.

Folding undoes look-alike letters of other scripts, digits and signs written for letters, wide
forms and case, so that a disguised word meets its plain form.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WordHashes, stored, text_chunks, texts_of
from barloom.llm.jaccard import shingle_sets

# Letters of other scripts, digits and signs that stand for Latin letters.
LOOK_ALIKES = str.maketrans(
    "авеіјкмнорсԛѕтуԝхһԁɡοανρτυικε013457@$ıℓ",
    "abeijkmhopcqstywxhdgoavptuikeoieastasil",
)
JOINERS = re.compile("[\u00ad\u200b-\u200f\u2060\ufe0f]")


@dataclass(frozen=True)
class LexiconRule:
    """``sample``: labelled documents that the lexicon is learned from, at most, which bounds
    its size too. ``prefixes``: lengths of the beginnings of words that can be terms. A term has
    ``min_docs`` toxic documents, log odds of ``min_weight`` and a deviation of ``min_z`` or more;
    a longer form of it below ``spared_weight`` is an exception phrase."""

    sample: int = 16_384
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)
    min_docs: int = 5
    min_weight: float = 2.0
    min_z: float = 4.0
    spared_weight: float = 0.0


@dataclass(frozen=True)
class Lexicon:
    """Folded terms with their weights (a term begins with the blank before a word), phrases that
    cancel the terms inside them, and the logistic curve over the two features."""

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)

    def packed(self) -> str:
        return json.dumps([self.weights, self.exceptions, self.curve])


def fold(text: str) -> str:
    """Lower case, plain letters for look-alikes and digits, one blank between words and at the
    ends. Accents stay: they tell words apart."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", JOINERS.sub("", text))
    return f" {' '.join(text.lower().translate(LOOK_ALIKES).split())} "


def candidate_terms(words: set[str], lengths: tuple[int, ...]) -> set[str]:
    found = {f" {w} " for w in words}
    for n in lengths:
        found.update(f" {w[:n]}" for w in words if len(w) >= n)
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, rule: LexiconRule) -> DataFrame:
    """Texts and labels of at most ``sample`` labelled documents, chosen by hash of the id.

    Only the ids chosen are broadcast, never more than ``sample``. An id labelled twice counts as
    toxic if one label says so; labels without an id or a value are left out. Of texts that are
    copies of one another, or nearly, about one per label is kept, or else the words of a much
    copied document would stand out: texts with the same smallest hash of three words in a row
    count as copies.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rule.sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def with_family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in text_chunks(batches):
            members, sizes = shingle_sets(texts_of(batch), 3, known)
            starts = np.cumsum(sizes) - sizes
            family = [int(members[s].view(np.int64)) if n else 0 for s, n in zip(starts, sizes)]
            columns = [pa.array(family, pa.int64()), batch.column("label"), batch.column("text")]
            yield pa.RecordBatch.from_arrays(columns, ["family", "label", "text"])

    rows = rows.select("text", "label").mapInArrow(with_family, "family long, label int, text string")
    return stored(rows.groupBy("family", "label").agg(F.min("text").alias("text")).select("text", "label"))


def term_counts(sample: DataFrame, rule: LexiconRule) -> DataFrame:
    """Toxic and clean documents of the sample that hold each candidate term."""
    lengths = rule.prefixes

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, limit=1 << 20):
            rows = [candidate_terms(set(fold(t).split()), lengths) for t in texts_of(batch)]
            labels = np.repeat(batch.column("label").to_numpy(), [len(r) for r in rows])
            flat = pa.array([t for r in rows for t in r], pa.string())
            yield pa.RecordBatch.from_arrays([flat, pa.array(labels, pa.int32())], ["term", "label"])

    found = sample.mapInArrow(terms, "term string, label int")
    return found.groupBy("term").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    rule: LexiconRule = LexiconRule(),
) -> Lexicon:
    """A lexicon from the labelled documents for which ``usable`` holds (all, if not given).

    Without labels, or without both classes, the lexicon is empty and every score is the same
    low one.
    """
    sample = labelled_sample(docs, labels, F.lit(True) if usable is None else usable, rule)
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    toxic, clean = totals.t, totals.n - totals.t
    if not toxic or not clean:
        return Lexicon(())
    in_toxic, in_clean = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
    pooled = (F.col("toxic") + F.col("clean") + 1) / (toxic + clean + 2)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / (toxic + 1) + 1 / (clean + 1)))
    counts = term_counts(sample, rule).withColumns(
        {"weight": F.log(in_toxic / in_clean), "z": (in_toxic - in_clean) / F.nullif(spread, F.lit(0.0))}
    )
    counts = stored(counts.where(F.col("toxic") + F.col("clean") >= rule.min_docs))
    strong = (F.col("weight") >= rule.min_weight) & (F.col("z") >= rule.min_z)
    picked = counts.where((F.col("toxic") >= rule.min_docs) & strong)
    picked = picked.orderBy(F.desc("z"), F.desc(F.length("term")), "term")
    weights = chosen_terms([(r.term, r.weight) for r in picked.collect()])
    if not weights:
        return Lexicon(())
    # Longer forms of a chosen term that do not stand out themselves.
    lengths = {n: [t for t in weights if len(t) == n] for n in {len(t) for t in weights}}
    longer = F.lit(False)
    for n, terms in lengths.items():
        longer |= (F.length("term") > n) & F.left("term", F.lit(n)).isin(terms)
    longer = counts.where((F.col("weight") < rule.spared_weight) & longer)
    spared = longer.orderBy(F.desc("clean"), "term").collect()
    lexicon = Lexicon(tuple(weights.items()), tuple(r.term for r in spared))
    return fitted_curve(sample, lexicon)


def chosen_terms(ranked: list[tuple[str, float]]) -> dict[str, float]:
    """The ranked terms without those that begin with, or are the beginning of, a better one."""
    kept: dict[str, float] = {}
    for term, weight in ranked:
        word = term.strip()
        known = any(word.startswith(k.strip()) or k.strip().startswith(word) for k in kept)
        if not known:
            kept[term] = float(weight)
    return kept


@functools.lru_cache(maxsize=4)
def automaton(packed: str) -> tuple[ahocorasick.Automaton, tuple[float, float, float]]:
    weights, exceptions, curve = json.loads(packed)
    machine = ahocorasick.Automaton()
    for phrase in exceptions:
        machine.add_word(phrase, (len(phrase), 0.0))
    for term, weight in weights:
        machine.add_word(term, (len(term), weight))
    if weights:
        machine.make_automaton()
    return machine, tuple(curve)


def weigh(machine: ahocorasick.Automaton, folded: str) -> float:
    """Summed weight of the terms found, less those inside an exception phrase.

    Overlapping terms that begin at one place count once, with the larger weight.
    """
    at: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    ends: dict[int, int] = {}
    for end, (size, weight) in machine.iter(folded):
        start = end - size + 1
        if weight:
            if weight > at.get(start, 0.0):
                at[start], ends[start] = weight, end
        else:
            spared.append((start, end))
    for first, last in spared:
        for start in [s for s in at if first <= s and ends[s] <= last]:
            del at[start]
    return sum(at.values())


def features(machine: ahocorasick.Automaton, texts: list[str]) -> np.ndarray:
    """Two numbers per text: the weight found, and the weight per 100 words, both as log(1 + x)."""
    out = np.zeros((len(texts), 2))
    if not len(machine):
        return out
    for i, text in enumerate(texts):
        folded = fold(text)
        total = weigh(machine, folded)
        if total:
            words = max(1, folded.count(" ") - 1)
            out[i] = total, 100.0 * total / words
    return np.log1p(out)


def fitted_curve(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The lexicon with a logistic curve fitted to the sample's rows (bounded, two numbers each)."""
    packed = lexicon.packed()

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = automaton(packed)
        for batch in text_chunks(batches):
            x = features(machine, texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("label").cast(pa.int32())],
                ["a", "b", "label"],
            )

    rows = sample.mapInArrow(numbers, "a double, b double, label int").toPandas()
    x = np.column_stack([np.ones(len(rows)), rows["a"], rows["b"]])
    y = rows["label"].to_numpy(dtype=float)
    curve, penalty = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (y - p) - penalty @ curve
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, slope)
        curve = curve + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.weights, lexicon.exceptions, tuple(round(float(c), 9) for c in curve))


def toxicity(text: Column, lexicon: Lexicon) -> Column:
    """Score of a text column from 0 to 1; a null or empty text scores as one without terms."""
    packed = lexicon.packed()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        machine, curve = automaton(packed)
        x = features(machine, [t or "" for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(curve[0] + x @ np.array(curve[1:]), -30, 30))))

    return score(text)


def held_out(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """Whether a document is kept from learning: CRC-32 of its id as text, modulo ``parts``. A
    null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == 0, F.lit(True))


def toxicity_scores(docs: DataFrame, labels: DataFrame, rule: LexiconRule = LexiconRule()) -> DataFrame:
    """Score and prediction per row; a null doc_id stays null. Labels serve learning only, and
    only those of rows that are not held out."""
    lexicon = learn_lexicon(docs, labels, ~held_out(), rule)
    rows = docs.select("doc_id", held_out().alias("held_out"), toxicity(F.col("text"), lexicon).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, rule: LexiconRule = LexiconRule()) -> DataFrame:
    """The documents with a score below 0.5, all columns."""
    lexicon = learn_lexicon(docs, labels, ~held_out(), rule)
    return docs.where(toxicity(F.col("text"), lexicon) < 0.5)
