"""Document fingerprints from improbable features.

A feature is a window of bytes. Windows are ranked by how rare their entropy is among all windows
of the corpus; in every run of consecutive windows the rarest wins, and windows that win often
enough are selected. Selected features are hashed into Bloom filters, chained as each fills up. Two
fingerprints are compared by the bits that their filters share beyond chance.

Entropy is kept as an integer, so equal texts have equal fingerprints on every machine.
"""

from __future__ import annotations

import functools
import hashlib

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import (
    document_key,
    key_or_null,
    scrambled,
    sequence,
    stored,
    text_chunks,
    texts_of,
)

ODD = 0x9E3779B97F4A7C15
BYTES = scrambled(np.arange(1, 257, dtype=np.uint64))
SHORT = np.uint64(0x2545F4914F6CDD1D)
PAIRS = (
    "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


@dataclass(frozen=True)
class DigestRule:
    """``window`` bytes to a feature, ``run`` windows to a contest, ``wins`` to be selected;
    entropy in ``levels`` steps; filters of ``bits`` bits with ``hashes`` per feature, ``fill``
    features each. ``rows``: documents of one stretch of the id order, about; beyond
    ``stretches`` of them they get longer, and a task reads through its own row by row. The bounds of
    stretches are found from about ``ids_for_cut`` sampled ids for each."""

    window: int = 32
    run: int = 32
    wins: int = 8
    levels: int = 1024
    bits: int = 2048
    hashes: int = 5
    fill: int = 160
    rows: int = 1024
    stretches: int = 65_536
    ids_for_cut: int = 32


@functools.cache
def steps(window: int) -> np.ndarray:
    """What one more byte that a window holds c times already adds to the sum of c * log2(c)."""
    c = np.arange(1, window + 1, dtype=np.float64)
    whole = np.append(0, np.round(c * np.log2(c) * 65536)).astype(np.int64)
    return np.diff(whole)


def window_levels(x: np.ndarray, rule: DigestRule) -> np.ndarray:
    """Entropy level of the window that ends at each byte; 0 is the most even window.

    The sum of c * log2(c) over a window's byte counts c changes by one step for the byte that
    enters and one for the byte that leaves, so only their counts within the window are needed.
    """
    n, w = len(x), rule.window
    before, after = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for d in range(1, min(w, n)):
        same = (x[d:] == x[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    step = steps(w)
    total = np.cumsum(step[before])
    total[w:] -= np.cumsum(step[after[: n - w]]) if n > w else 0
    most = int(step.sum())
    return np.minimum(total * rule.levels // (most + 1), rule.levels - 1)


def least_in_run(x: np.ndarray, run: int) -> np.ndarray:
    done = 1
    while done < run:
        step = min(done, run - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def selected(ranks: np.ndarray, sizes: np.ndarray, rule: DigestRule) -> np.ndarray:
    """Ends of the selected windows. ``ranks`` is by end of window, over texts of ``sizes`` bytes.

    A contest lies within one text and its first window wins a tie. A text with fewer windows than
    a contest takes holds one contest; a text in which no window wins often enough selects the
    window that wins most often, the first of them.
    """
    n = len(ranks)
    owner, place = sequence(sizes)
    kind = np.uint32 if n < 1 << 22 and rule.levels <= 1 << 10 else np.uint64
    shift = kind(22 if kind is np.uint32 else 40)
    keys = (ranks.astype(kind) << shift) | np.arange(n, dtype=kind)
    won = np.zeros(n, dtype=np.int64)
    if n >= rule.run:
        best = least_in_run(keys, rule.run) & kind((1 << int(shift)) - 1)
        # The contest that begins at a byte ends run - 1 bytes on; all its windows lie in the text.
        begin = np.arange(len(best))
        fits = (place[begin] >= rule.window - 1) & (owner[begin] == owner[begin + rule.run - 1])
        won = np.bincount(best[fits].astype(np.int64), minlength=n)
    often = won >= rule.wins
    windows = sizes - rule.window + 1
    starts = np.cumsum(sizes) - sizes
    have = np.bincount(owner[often], minlength=len(sizes)) if n else np.zeros(len(sizes), np.int64)
    for t in np.flatnonzero((have == 0) & (windows > 0)).tolist():
        first, last = starts[t] + rule.window - 1, starts[t] + sizes[t]
        score = won[first:last]
        pick = int(np.argmax(score)) if score.any() else int(np.argmin(keys[first:last]))
        often[first + pick] = True
    return np.flatnonzero(often)


@functools.lru_cache(maxsize=8)
def byte_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's factor and of its inverse modulo 2 ** 64."""
    out = []
    for factor in (ODD, pow(ODD, -1, 2**64)):
        row = np.full(size, factor, dtype=np.uint64)
        row[:1] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def feature_hashes(x: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    up, down = (p[: len(x)] for p in byte_powers(1 << max(12, int(len(x)).bit_length())))
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(BYTES[x] * down, out=sums[1:])
    starts = ends - window + 1
    return scrambled((sums[ends + 1] - sums[starts]) * up[starts])


def fingerprints(texts: list[bytes], ranks: np.ndarray, rule: DigestRule) -> list[np.ndarray]:
    """Bloom filters of each text, a row of bytes per filter; none for an empty text. A text
    shorter than a window is one feature as a whole."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    x = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner, _ = sequence(sizes)
    if len(x):
        ends = selected(ranks[window_levels(x, rule)], sizes, rule)
    else:
        ends = np.zeros(0, dtype=np.int64)
    found, of = feature_hashes(x, ends, rule.window), owner[ends]
    small = np.flatnonzero((sizes > 0) & (sizes < rule.window))
    if len(small):
        whole = [int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in small]
        found = np.append(found, np.array(whole, dtype=np.uint64) ^ SHORT)
        of = np.append(of, small)
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    counts = np.bincount(of, minlength=len(texts))
    filters = -(-counts // rule.fill)
    first = np.cumsum(filters) - filters
    _, rank = sequence(counts)
    at = (first[of] + rank // rule.fill) * rule.bits
    bits = np.zeros(int(filters.sum()) * rule.bits, dtype=np.uint8)
    each = rule.bits.bit_length() - 1
    for h in range(rule.hashes):
        part = (found >> np.uint64(h * each)) & np.uint64(rule.bits - 1)
        bits[at + part.astype(np.int64)] = 1
    packed = np.packbits(bits, bitorder="little").reshape(-1, rule.bits // 8)
    return [packed[f : f + c] for f, c in zip(first.tolist(), filters.tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller fingerprint's bits found in the other's best filter, beyond chance.

    Each filter of the fingerprint with fewer filters is held against all of the other's; 0 is what
    chance gives, up to two of its standard deviations, and 1 is all that can be shared. Filters weigh by their bits. Equal fingerprints have
    likeness 1, also empty ones; an empty and another have 0.
    """
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(a), a.tobytes()) > (len(b), b.tobytes()):
        a, b = b, a
    set_a, set_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    total, bits = 0.0, a.shape[1] * 8
    for row, mine in zip(a, set_a.tolist()):
        shared = np.bitwise_count(b & row).sum(axis=1, dtype=np.int64)
        chance = mine * set_b / bits
        most = np.minimum(mine, set_b)
        luck = chance + 2 * np.sqrt(chance * (1 - set_b / bits))
        score = np.where(shared > luck, (shared - chance) / np.maximum(most - chance, 1e-9), 0.0)
        total += mine * float(np.clip(score.max(), 0.0, 1.0))
    return total / float(set_a.sum())


def entropy_ranks(docs: DataFrame, rule: DigestRule) -> np.ndarray:
    """Rank of every entropy level, the rarest over all windows of the corpus first. One row per
    level is collected."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(rule.levels, dtype=np.int64)
        for batch in text_chunks(batches):
            texts = [t.encode() for t in texts_of(batch)]
            x = np.frombuffer(b"".join(texts), dtype=np.uint8)
            _, place = sequence(np.array([len(t) for t in texts], dtype=np.int64))
            if len(x):
                levels = window_levels(x, rule)[place >= rule.window - 1]
                counts += np.bincount(levels, minlength=rule.levels)
        held = np.flatnonzero(counts)
        columns = [pa.array(held), pa.array(counts[held])]
        yield pa.RecordBatch.from_arrays(columns, ["level", "windows"])

    rows = docs.select("text").mapInArrow(counted, "level long, windows long")
    found = rows.groupBy("level").agg(F.sum("windows").alias("windows")).collect()
    counts = np.zeros(rule.levels, dtype=np.int64)
    for row in found:
        counts[row.level] = row.windows
    ranks = np.empty(rule.levels, dtype=np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(rule.levels)
    return ranks


def stretches(docs: DataFrame, rule: DigestRule) -> DataFrame:
    """``doc, text, stretch, follows``: the documents in stretches of the id order, largest first.

    Each stretch also gets the first document of the next one (``follows`` is true), and the last
    stretch that of the first, so that every document meets the one after it. A stretch's bounds
    are approximate quantiles: they deal out the work and change no result.
    """
    rows = docs.select(document_key().alias("doc"), F.xxhash64("text").alias("body"), "text")
    ids = stored(rows.select("doc", "body"))
    count = ids.count()
    n = min(rule.stretches, 1 + count // rule.rows)
    quantiles = F.percentile_approx("doc", [i / n for i in range(1, n)], 4 * n) if n > 1 else F.array()
    some = ids.sample(fraction=min(1.0, rule.ids_for_cut * n / max(count, 1)), seed=n)
    cuts = np.unique(np.array(some.agg(quantiles.alias("cuts")).first().cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def stretch(doc: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, doc.to_numpy())).astype(np.int32))

    # One row per stretch, ``rule.stretches`` at most.
    heads = ids.groupBy(stretch("doc").alias("stretch")).agg(F.max(F.struct("doc", "body")).alias("head"))
    order = Window.orderBy("stretch")
    last = F.max("stretch").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.withColumn("also", F.coalesce(F.lag("stretch").over(order), last))
    heads = heads.select("head.doc", "head.body", "also")
    rows = rows.withColumn("stretch", stretch("doc")).join(F.broadcast(heads), ["doc", "body"], "left")
    homes = F.array(
        F.struct(F.col("stretch"), F.lit(False).alias("follows")),
        F.struct(F.col("also").alias("stretch"), F.lit(True).alias("follows")),
    )
    homes = F.filter(homes, lambda h: h["stretch"].isNotNull())
    return rows.select("doc", "body", "text", F.inline(homes))


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbour_digests(docs: DataFrame, rule: DigestRule = DigestRule()) -> DataFrame:
    """Per row: its fingerprint, that of its text edited with the next document's, and how alike
    they and the next document's are.

    The next document has the next smaller doc_id, and the last one is followed by the first; rows
    without an id are the smallest, and rows that share one are ordered by a hash of their text. A
    table of one row is followed by itself. A null text is an empty one, whose fingerprint is the
    empty string.
    """
    ranks = entropy_ranks(docs, rule)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bool, str, np.ndarray]] = []
        for batch in text_chunks(batches, limit=1 << 20):
            texts = texts_of(batch)
            prints = fingerprints([t.encode() for t in texts], ranks, rule)
            heads = zip(batch.column("stretch").to_pylist(), batch.column("doc").to_pylist(), batch.column("follows").to_pylist())
            rows = held + [(*h, t, p) for h, t, p in zip(heads, texts, prints)]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[2]]
            held = rows[-1:]
            changed = [edited(a[3], b[3]) for a, b in pairs]
            others = fingerprints([c.encode() for c in changed], ranks, rule)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[1] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                    pa.array([a[4].tobytes().hex() for a, _ in pairs], pa.string()),
                    pa.array([o.tobytes().hex() for o in others], pa.string()),
                    pa.array([likeness(a[4], o) for (a, _), o in zip(pairs, others)], pa.float64()),
                    pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                ],
                ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    rows = stretches(docs, rule).repartition("stretch")
    rows = rows.sortWithinPartitions("stretch", "follows", F.desc("doc"), F.desc("body"))
    return rows.select("stretch", "follows", "doc", "text").mapInArrow(compared, PAIRS)


def fingerprint_report(docs: DataFrame, rule: DigestRule = DigestRule()) -> DataFrame:
    found = neighbour_digests(docs.select("doc_id", "text"), rule)
    return found.select(key_or_null(F.col("doc")).alias("doc_id"), *found.columns[1:])
