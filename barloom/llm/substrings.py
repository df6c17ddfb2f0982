"""Repeated word windows, found by doubling their length level by level.

A window is a run of consecutive words of one document. The first level tests windows of half the
length, one per neighbourhood: of every ``length / 2 + 1`` windows in a row the one with the
smallest hash. Copies of a long window hold the same words, so they choose the same. Only around
chosen windows that a document with another id repeats are windows of twice the length formed, and
those of them that repeat are extended to twice that length, and so on until no candidates survive
(``repeat_levels``). What is covered by longer windows is covered by those of the given length, so
dedup stops there.

Documents of one word sequence are one document here, the one with the smallest id; all windows
of the others start in it. Hashes of the last level have 128 bits.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import (
    WordHashes,
    document_key,
    key_or_null,
    scrambled,
    sequence,
    stored,
    text_chunks,
    texts_of,
    word_arrays,
)

# Odd factors of the two rolling hashes, their inverses modulo 2 ** 64, and salts.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(f, -1, 2**64) for f in FACTORS)
SALT = np.uint64(0x5851F42D4C957F2D)
MARKS = "doc long, body long, n_words long, w1 long, w2 long, sha string, marks array<long>"
WINDOWS = "doc long, body long, start int, h1 long, h2 long"


@dataclass(frozen=True)
class WindowRule:
    """Windows of ``length`` words, an even number; level by level from half of it."""

    length: int = 50

    @property
    def half(self) -> int:
        return self.length // 2


class Rolling:
    """Hashes of all windows of a length over word hashes laid end to end."""

    def __init__(self, hashes: np.ndarray, which: int = 0) -> None:
        n = len(hashes)
        self.up = powers(FACTORS[which], n)
        down = powers(INVERSES[which], n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * down, out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """One hash per place where a window fits into the array."""
        count = max(0, len(self.up) - length + 1)
        return scrambled((self.sums[length : length + count] - self.sums[:count]) * self.up[:count])


def powers(factor: int, n: int) -> np.ndarray:
    """1, factor, factor ** 2, … modulo 2 ** 64."""
    out = np.full(n, factor, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def least_in_reach(x: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of every ``reach`` values in a row."""
    done = 1
    while done < reach:
        step = min(done, reach - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def chosen_windows(
    hashes: np.ndarray, owner: np.ndarray, rule: WindowRule
) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the full length: its place, and the hash of the half window chosen in it."""
    count = max(0, len(hashes) - rule.length + 1)
    inside = np.flatnonzero(owner[:count] == owner[rule.length - 1 :][:count])
    chosen = least_in_reach(Rolling(hashes).windows(rule.half), rule.half + 1)
    return inside, chosen[inside]


def distinct_neighbours(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without those equal to the pair before."""
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    return distinct_neighbours(a[order], b[order])


def marks(docs: DataFrame, rule: WindowRule) -> DataFrame:
    """Per row: words, hashes and digest of the word sequence, and the half windows chosen."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in text_chunks(batches):
            texts = [t.encode() for t in texts_of(batch)]
            hashes, counts = word_arrays(texts, known)
            owner, place = sequence(counts)
            inside, chosen = chosen_windows(hashes, owner, rule)
            of, chosen = distinct_pairs(*distinct_neighbours(owner[inside], chosen))
            sizes = np.bincount(of, minlength=len(texts))
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            wholes = []
            for which in (0, 1):
                into = np.zeros(len(texts), dtype=np.uint64)
                terms = scrambled(hashes ^ scrambled(place.astype(np.uint64) + SALT * np.uint64(which + 1)))
                np.add.at(into, owner, terms)
                wholes.append(into.view(np.int64))
            shas = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    batch.column("body"),
                    pa.array(counts),
                    pa.array(wholes[0]),
                    pa.array(wholes[1]),
                    pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(chosen.view(np.int64))),
                ],
                ["doc", "body", "n_words", "w1", "w2", "sha", "marks"],
            )

    rows = docs.select(document_key().alias("doc"), F.xxhash64("text").alias("body"), "text")
    return rows.mapInArrow(marked, MARKS)


def shared_by_documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that stand in documents of different ids, and the smallest of the ids."""
    found = rows.groupBy(*keys).agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    return found.where("low < high").drop("high")


def repeated_marks(signed: DataFrame) -> DataFrame:
    """``doc, body, found``: per row, the chosen half windows that another document chose too."""
    rows = signed.select("doc", "body", F.explode("marks").alias("mark"))
    found = rows.join(shared_by_documents(rows, ["mark"]).drop("low"), "mark")
    return found.groupBy("doc", "body").agg(F.collect_list("mark").alias("found"))


def candidate_windows(texts: DataFrame, rule: WindowRule) -> DataFrame:
    """The windows of full length around the half windows in ``found``: hashes and places."""

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in text_chunks(batches):
            hashes, counts = word_arrays([t.encode() for t in texts_of(batch)], known)
            owner, place = sequence(counts)
            inside, chosen = chosen_windows(hashes, owner, rule)
            found = batch.column("found")
            rows = np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy())
            wanted = found.flatten().to_numpy().view(np.uint64)
            # A half window counts in the row whose list holds it.
            keep = np.isin(
                scrambled(chosen ^ scrambled(owner[inside].astype(np.uint64))),
                scrambled(wanted ^ scrambled(rows.astype(np.uint64))),
            )
            inside = inside[keep]
            pair = [Rolling(hashes, which).windows(rule.length)[inside] for which in (0, 1)]
            of = pa.array(owner[inside])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(of),
                    batch.column("body").take(of),
                    pa.array(place[inside].astype(np.int32)),
                    pa.array(pair[0].view(np.int64)),
                    pa.array(pair[1].view(np.int64)),
                ],
                ["doc", "body", "start", "h1", "h2"],
            )

    return texts.mapInArrow(formed, WINDOWS)


def window_table(docs: DataFrame, signed: DataFrame, rule: WindowRule) -> DataFrame:
    """Candidate windows of the full length of the documents that stand for a word sequence."""
    names = signed.where(F.col("n_words") >= rule.length).groupBy("w1", "w2")
    names = names.agg(F.min(F.struct("doc", "body")).alias("rep"))
    names = names.select("rep.doc", "rep.body").distinct()
    signed = signed.select("doc", "body", "marks").join(names, ["doc", "body"], "left_semi")
    found = stored(repeated_marks(stored(signed.dropDuplicates(["doc", "body"]))))
    rows = docs.select(document_key().alias("doc"), F.xxhash64("text").alias("body"), "text")
    return stored(candidate_windows(rows.join(found, ["doc", "body"]), rule))


def repeat_levels(docs: DataFrame, rule: WindowRule = WindowRule()) -> DataFrame:
    """``doc, body, start, length``: all windows of ``length``, 2 * ``length``, … words that start in
    documents of different ids, up to the longest such window.

    A window of the next level is made of two of this one, end to end, both repeated; its hashes
    are made of theirs. Word sequences that are wholly alike are represented by one document.
    """
    windows, length, out = window_table(docs, stored(marks(docs, rule)), rule), rule.length, None
    while True:
        shared = stored(shared_by_documents(windows, ["h1", "h2"]).drop("low"))
        found = stored(windows.join(shared, ["h1", "h2"]).distinct())
        level = found.select("doc", "body", "start", F.lit(length).alias("length"))
        out = level if out is None else out.unionByName(level)
        if found.isEmpty():
            return out
        rest = found.select(
            "doc",
            "body",
            (F.col("start") - length).cast("int").alias("start"),
            F.col("h1").alias("next1"),
            F.col("h2").alias("next2"),
        )
        windows = found.join(rest, ["doc", "body", "start"]).select(
            "doc",
            "body",
            "start",
            F.xxhash64("h1", "next1").alias("h1"),
            F.xxhash64(F.lit(length), "h2", "next2").alias("h2"),
        )
        windows, length = stored(windows), 2 * length


def later_windows(docs: DataFrame, signed: DataFrame, rule: WindowRule) -> DataFrame:
    """``doc, body, starts``: places of the windows whose words start in a smaller document too."""
    windows = window_table(docs, signed, rule)
    # Written, so that the join reads two plain tables and Spark can split a frequent window's task.
    low = stored(shared_by_documents(windows, ["h1", "h2"]))
    later = windows.join(low, ["h1", "h2"]).where("low < doc")
    later = later.select("doc", "body", "start").distinct()
    return later.groupBy("doc", "body").agg(F.sort_array(F.collect_list("start")).alias("starts"))


def covered(starts: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """Which words lie in a window that begins at one of the starts."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + length, n_words), -1)
    return np.cumsum(edges[:-1]) > 0


def dedup_windows(docs: DataFrame, rule: WindowRule = WindowRule()) -> DataFrame:
    """Per row of ``docs``: ``doc, body, n_words, n_removed, kept`` — the words left, joined by one
    space — or a null ``kept`` where nothing is removed; ``sha`` is its digest in both cases.

    A word goes if it lies in a window whose word sequence starts in a document with a smaller id
    as well. Windows are judged on the input. A text without words, empty or null, has none left;
    rows that share an id are one document, and repeats within a document stay. A row without an
    id is a document of its own, told apart by its text and before all others. Other columns do
    not matter.
    """
    length = rule.length
    signed = stored(marks(docs, rule))
    starts = later_windows(docs, signed, rule)
    first = stored(signed.groupBy("w1", "w2").agg(F.min("doc").alias("first")))
    rows = signed.drop("marks").join(first, ["w1", "w2"]).drop("w1", "w2")
    # All windows of a copy start in the first document of its word sequence.
    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= length)
    rows = stored(rows.withColumn("copy", copy).drop("first"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            counts, kept = [], []
            for text, places in zip(texts_of(batch), batch.column("starts")):
                words = text.encode().split()
                gone = covered(places.values.to_numpy().astype(np.int64), len(words), length)
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
                counts.append(int(gone.sum()))
            shas = [hashlib.sha256(k).hexdigest() for k in kept]
            left = pa.array([k.decode() for k in kept], pa.string())
            columns = [batch.column("doc"), batch.column("body"), pa.array(counts, pa.int64()), left, pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "body", "removed", "kept", "sha_left"])

    texts = docs.select(document_key().alias("doc"), F.xxhash64("text").alias("body"), "text")
    parts = texts.join(starts, ["doc", "body"]).dropDuplicates(["doc", "body"])
    parts = parts.mapInArrow(cut, "doc long, body long, removed long, kept string, sha_left string")
    rows = rows.join(parts, ["doc", "body"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "doc",
        "body",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(F.col("copy"), F.lit(none)).otherwise(F.coalesce("sha_left", "sha")).alias("sha"),
    )


def window_digests(docs: DataFrame, rule: WindowRule = WindowRule()) -> DataFrame:
    rows = dedup_windows(docs.select("doc_id", "text"), rule)
    return rows.select(
        key_or_null(F.col("doc")).alias("doc_id"),
        "n_words",
        F.col("n_removed").cast("long").alias("n_removed"),
        F.col("sha").alias("kept_sha256"),
    )
