"""Self-join of word n-gram sets by Jaccard similarity.

A set is the sorted array of 64-bit hashes of its shingles, in one order for all documents. Equal
sets are one class, kept once. For sets of sizes a and b that reach the threshold p, both beginnings
of length (size - ceil(p * size) + m) share m shingles or more, so

1. every class emits such a beginning; classes whose beginning holds fewer shared shingles than any
   partner would need have no partner and go. What many documents merely quote does not keep them;
2. the rest meet in tiles: a shingle of the shorter beginning (m = 1) and a block of the classes
   that hold it, cut in order of size. Only blocks whose sizes can reach the threshold meet;
3. in a tile, hashed bitmap signatures bound the overlap from above: a shingle flips one bit, so
   two bitmaps differ in no more bits than their sets differ in shingles;
4. pairs within the bound are confirmed by intersecting the sorted arrays.

Before the tiles every class is tried against one other, the smallest class of the tile group with
which it shares most shingles. Tile groups that this makes one component need no tile, so a large
group of near copies costs as many tries as it has members, not as many as it has pairs; in the
others only pairs of different components are tried.
"""

from __future__ import annotations

import itertools

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import (
    WordHashes,
    document_key,
    inner_tables,
    key_or_null,
    scrambled,
    sequence,
    stored,
    text_chunks,
    texts_of,
    word_arrays,
)
from barloom.llm.graph import components

# Odd numbers that place the words of a shingle.
PLACES = scrambled(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
SALTS = scrambled(np.arange(101, 105, dtype=np.uint64))
SIGNATURE = "doc long, body long, n int, h1 long, h2 long, start array<long>"
SETS = "class long, n int, bits binary, members binary"


@dataclass(frozen=True)
class JaccardRule:
    """``words`` to a shingle; sets link when 100 * intersection >= ``percent`` * union.
    ``block``: classes of a tile's side. ``first_tiles`` of a class go along with it, so that a
    pair is tried in one tile and not in all that it shares."""

    words: int = 5
    percent: int = 80
    block: int = 256
    first_tiles: int = 2

    def least_overlap(self, n: np.ndarray) -> np.ndarray:
        """Shingles that a set of n shares with any partner, at least."""
        return -(-self.percent * n // 100)

    def shared(self, n: np.ndarray) -> np.ndarray:
        """Shared shingles that the longer beginning of a set of n is made for."""
        return np.minimum(1 + n * (100 - self.percent) // 200, self.least_overlap(n))

    def links(self, overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 100 * overlap >= self.percent * (sizes - overlap)


def shingle_sets(texts: list[str], words: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, one text after the other, and each text's number of them.

    A-Z are lower-cased first. A text of fewer words is one shingle, one of none has no shingle.
    """
    hashes, counts = word_arrays([t.encode().lower() for t in texts], known)
    owner, _ = sequence(counts)
    total = max(0, len(hashes) - words + 1)
    sums = np.zeros(total, dtype=np.uint64)
    for j in range(words):
        sums += hashes[j : j + total] * PLACES[j % 64]
    whole = owner[:total] == owner[words - 1 :][:total]
    found, owners = scrambled(sums[whole]), owner[:total][whole]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        starts = np.cumsum(counts) - counts
        ends = [hashes[s : s + c] for s, c in zip(starts[short], counts[short])]
        sums = np.array([(e * PLACES[: len(e)]).sum() for e in ends], dtype=np.uint64)
        found, owners = np.append(found, scrambled(sums + SALTS[3])), np.append(owners, short)
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])
    return found[new], np.bincount(owners[new], minlength=len(texts))


def bitmaps(members: np.ndarray, sizes: np.ndarray, percent: int = 80) -> list[bytes]:
    """A bitmap per set: a power of two of bits. Where a fifth of the members may differ, 256 at least
    and as many as the set has members or more; in proportion for other thresholds. A member flips the bit that its low digits name, so halving a bitmap is an XOR."""
    owner, _ = sequence(sizes)
    wanted = np.maximum(sizes * (100 - percent) // 20, 1)
    least = max(6, (256 * (100 - percent) // 20 - 1).bit_length())
    widths = 1 << np.maximum(least, np.ceil(np.log2(wanted)).astype(np.int64))
    starts = np.cumsum(widths) - widths
    place = (scrambled(members ^ SALTS[2]) & (widths[owner] - 1).astype(np.uint64)).astype(np.int64)
    flips = np.bincount(starts[owner] + place, minlength=int(widths.sum())) & 1
    packed = np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()
    return [packed[s // 8 : (s + w) // 8] for s, w in zip(starts.tolist(), widths.tolist())]


def folded(bits: bytes, words: int) -> np.ndarray:
    """A bitmap as 64-bit words, halved until it has so many."""
    out = np.frombuffer(bits, dtype=np.uint64)
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def differing(a: bytes, b: bytes) -> int:
    words = min(len(a), len(b)) // 8
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def signatures(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    """Per row: key, size and hashes of its set, and the beginning of its sorted set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in text_chunks(batches):
            members, sizes = shingle_sets(texts_of(batch), rule.words, known)
            owner, rank = sequence(sizes)
            sums = []
            for salt in SALTS[:2]:
                into = np.zeros(len(sizes), dtype=np.uint64)
                np.add.at(into, owner, scrambled(members ^ salt))
                sums.append(into.view(np.int64))
            length = sizes - rule.least_overlap(sizes) + rule.shared(sizes)
            ends = np.append(0, np.cumsum(length)).astype(np.int32)
            begin = members[rank < length[owner]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    batch.column("body"),
                    pa.array(sizes.astype(np.int32)),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(begin)),
                ],
                ["doc", "body", "n", "h1", "h2", "start"],
            )

    return keyed(docs).mapInArrow(signed, SIGNATURE)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(document_key().alias("doc"), F.xxhash64("text").alias("body"), "text")


def set_rows(docs: DataFrame, classes: DataFrame, rule: JaccardRule) -> DataFrame:
    """Whole sets of the documents that stand for the given classes. Their texts are shuffled
    compressed one by one, in two thirds of the bytes that the shuffle's own compression leaves."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [press.compress(t.encode()) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("body"), pa.array(texts, pa.binary())], ["doc", "body", "text"]
            )

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Some texts to a batch, 1 MB or one text of more."""
        press = zstandard.ZstdDecompressor()
        ids, texts, size = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("class").to_pylist(), batch.column("text")):
                ids.append(name)
                texts.append(press.decompress(text.as_py()).decode())
                size += len(texts[-1])
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["class", "text"])
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["class", "text"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in unpacked(batches):
            members, sizes = shingle_sets(texts_of(batch), rule.words, known)
            ends = np.cumsum(sizes)
            parts = [members[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("class"),
                    pa.array(sizes.astype(np.int32)),
                    pa.array(bitmaps(members, sizes, rule.percent), pa.binary()),
                    pa.array(parts, pa.binary()),
                ],
                ["class", "n", "bits", "members"],
            )

    # Sorted and merged at every size: repeated rows then lie side by side and are dropped before
    # their sets are made.
    texts = keyed(docs).mapInArrow(packed, "doc long, body long, text binary")
    texts = texts.join(classes.hint("merge"), ["doc", "body"]).dropDuplicates(["doc", "body"])
    return texts.select(F.col("doc").alias("class"), "text").mapInArrow(listed, SETS)


def candidate_classes(
    signed: DataFrame, rule: JaccardRule, keep: Callable[[DataFrame], DataFrame] = stored
) -> tuple[DataFrame, DataFrame]:
    """The classes that may have a partner (``class``, with the ``doc, body`` that stands for it),
    and a row for every shingle in their shorter beginning that another class has in its own
    (``tile, class, n``).

    Both are written by ``keep``. Until shingles that one class alone has are gone, classes go by a hash of their set. Copies
    then fall together in the aggregation before the shuffle.
    """
    signed = signed.where("n > 0")
    least = F.ceil(F.lit(rule.percent) * F.col("n") / 100)
    short = (F.col("n") - least + 1).cast("int")
    rows = signed.select("h1", F.posexplode("start").alias("place", "tile"), short.alias("short"))
    rows = rows.select("tile", "h1", (F.col("place") < F.col("short")).alias("early"))
    shared = rows.groupBy("tile").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
    shared = shared.where("low < high").select("tile")
    rows = stored(rows.join(shared, "tile").distinct())
    # The smallest partner has percent * n shingles; its beginning is made for this many.
    partner = F.ceil(F.lit(rule.percent) * F.col("n") / 100)
    need = 1 + F.floor(partner * (100 - rule.percent) / 200)
    need = F.least(need, F.ceil(F.lit(rule.percent) * partner / 100))
    stands = F.min(F.struct("doc", "body")).alias("rep")
    names = signed.groupBy("h1", "h2").agg(stands, F.first("n").alias("n"))
    names = names.select("h1", "h2", "n", "rep.doc", "rep.body")
    held = rows.join(names.hint("merge"), "h1")
    held = held.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("h1", "h2")))
    held = stored(held.where(F.col("held") >= need).select("tile", "early", "n", "doc", "body"))
    rows = held.where("early").select("tile", F.col("doc").alias("class"), "n")
    return keep(held.select(F.col("doc").alias("class"), "doc", "body").distinct()), keep(rows.distinct())


def first_tries(rows: DataFrame) -> DataFrame:
    """One pair per class: with the smallest class of the tile group it shares most tiles with."""
    # Two written tables, so that Spark can split the task of a tile that very many classes share.
    low = stored(rows.groupBy("tile").agg(F.min("class").alias("low")))
    pairs = rows.join(low, "tile").where("low < class").groupBy("class", "low").count()
    best = F.max(F.struct("count", (-F.col("low")).alias("less"))).alias("best")
    return pairs.groupBy("class").agg(best).select((-F.col("best.less")).alias("a"), F.col("class").alias("b"))


def confirmed(pairs: DataFrame, sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the threshold: first by bitmap, then by intersection."""

    def side(end: str, *columns: str) -> DataFrame:
        """The columns of ``sets``, as it is at the time, for one end of the pairs."""
        return sets.select(F.col("class").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            sizes, least = n_a + n_b, np.minimum(n_a, n_b)
            pairs_of_bits = zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
            off = np.array([differing(x, y) for x, y in pairs_of_bits], dtype=np.int64)
            # Sets of unlike sizes share no more than the smaller one holds, whatever their bitmaps say.
            keep = rule.links(np.minimum((sizes - off) // 2, least), sizes)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b")):
                left, right = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                overlap = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(bool(rule.links(overlap, len(left) + len(right))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with inner_tables(pairs.sparkSession) as keep:
        near = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
        near = near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(bounded, "a long, b long")
        near = stored(near)
        ids = near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class")))
        # Whole sets travel only for classes that are in a pair still.
        sets = stored(sets.select("class", "members").join(ids.distinct(), "class"))
        whole = near.join(side("a", "members"), "a").join(side("b", "members"), "b")
        whole = whole.select("a", "b", "members_a", "members_b")
        return keep(whole.mapInArrow(intersected, "a long, b long"))


def tiles(rows: DataFrame, labels: DataFrame, sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """Rows of the tiles that are left: both sides of each, with size, label, bitmap, and the first
    tiles that the class is in."""
    early = rows
    rows = rows.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    rows = stored(rows)
    # Numbered by the counts of each size, of which a tile has no more than sizes; a size of many
    # classes is cut by hash. No block has smaller classes than the one before, and no task holds a tile.
    sizes = rows.groupBy("tile", "n").agg(
        F.count(F.lit(1)).alias("held"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    whole, by_size = Window.partitionBy("tile"), Window.partitionBy("tile").orderBy("n")
    before = F.sum("held").over(by_size) - F.col("held")
    smaller, larger = F.lag("n").over(by_size), F.lead("n").over(by_size)
    reach = (smaller * 100 >= F.col("n") * rule.percent) | (F.col("n") * 100 >= larger * rule.percent)
    mixed = F.min("low").over(whole) < F.max("high").over(whole)
    first, parts = F.floor(before / rule.block), F.ceil(F.col("held") / rule.block)
    sizes = sizes.withColumns(
        {"mixed": mixed, "reach": (F.col("held") > 1) | reach, "head": first, "parts": parts}
    )
    sizes = stored(sizes.where("mixed and reach").select("tile", "n", "head", "parts"))
    cut = F.col("head") + F.pmod(F.xxhash64("class"), F.col("parts"))
    rows = rows.join(sizes, ["tile", "n"]).withColumn("block", cut.cast("int"))
    rows = stored(rows.select("tile", "class", "n", "label", "block"))
    blocks = rows.groupBy("tile", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left = blocks.select("tile", F.col("block").alias("i"), "most")
    right = blocks.select("tile", F.col("block").alias("j"), "least")
    meet = left.join(right, "tile").where(
        (F.col("i") <= F.col("j")) & (F.col("most") * 100 >= F.col("least") * rule.percent)
    )
    meet = stored(meet.select("tile", "i", "j"))
    upper = rows.withColumnRenamed("block", "i").join(meet, ["tile", "i"]).withColumn("side", F.lit(0))
    lower = rows.withColumnRenamed("block", "j").join(meet.where("i < j"), ["tile", "j"])
    both = upper.unionByName(lower.withColumn("side", F.lit(1)))
    lists = early.groupBy("class").agg(F.sort_array(F.collect_list("tile")).alias("all"))
    carried = sets.select("class", "bits").join(lists, "class")
    carried = carried.select("class", "bits", F.slice("all", 1, rule.first_tiles).alias("first"))
    return both.join(carried, "class").select(
        "tile", "i", "j", "side", "class", "n", "label", "bits", "first"
    )


def tile_pairs(rows: DataFrame, rule: JaccardRule) -> DataFrame:
    """Pairs of different labels in each tile whose bitmaps leave the threshold within reach.

    A pair that meets in one of the first tiles of both is left to the first such tile.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in whole_groups(batches, ["tile", "i", "j"]):
            side = tile.column("side").to_numpy()
            ids, sizes, labels = (tile.column(c).to_numpy() for c in ("class", "n", "label"))
            sizes = sizes.astype(np.int64)
            bits = tile.column("bits").to_pylist()
            widths = np.array([len(b) // 8 for b in bits])
            # Rows come in order of size, so bitmaps get no narrower; all from one width on, folded to it.
            first = np.flatnonzero(side == 0)
            second = np.flatnonzero(side == 1) if side.any() else first
            wide = {
                w: np.array([folded(bits[y], w) for y in second[widths[second] >= w].tolist()])
                for w in np.unique(widths[first]).tolist()
            }
            here = tile.column("tile")[0].as_py()
            started = np.full((len(ids), rule.first_tiles), here, dtype=np.int64)
            for row, tiles_of in enumerate(tile.column("first").to_pylist()):
                started[row, : len(tiles_of)] = tiles_of
            out = []
            for x in first.tolist():
                near = (labels[second] != labels[x]) & (rule.percent * sizes[second] <= 100 * sizes[x])
                near &= (second > x) & (widths[second] >= widths[x])
                before = started[x][started[x] < here]
                if len(before):
                    near &= ~np.isin(started[second], before).any(axis=1)
                if not near.any():
                    continue
                others = second[near]
                w = int(widths[x])
                rows_of = wide[w][near[widths[second] >= w]]
                off = np.bitwise_count(rows_of ^ folded(bits[x], w)).sum(axis=1, dtype=np.int64)
                both = sizes[others] + sizes[x]
                reach = rule.links(np.minimum((both - off) // 2, sizes[x]), both)
                out += [(ids[x], ids[y]) for y in others[reach].tolist()]
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "side", "n", "class")
    pairs = rows.mapInArrow(compared, "a long, b long").where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, which may lie across batches."""
    rest: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            if rest:
                yield pa.Table.from_batches(rest)
            return
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            piece = batch.slice(start, end - start)
            if rest and any(piece.column(k)[0] != rest[0].column(k)[0] for k in keys):
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(piece)


def near_links(docs: DataFrame, classes: DataFrame, rows: DataFrame, rule: JaccardRule) -> DataFrame:
    """Linked classes ``a, b``: all first tries that hold, and all that the tiles then find."""
    with inner_tables(docs.sparkSession) as keep:
        sets = stored(set_rows(docs, classes.select("doc", "body"), rule))
        links = confirmed(first_tries(rows), sets, rule)
        with inner_tables(docs.sparkSession) as keep_pairs:
            labels = components(links).toDF("class", "label")
            pairs = keep_pairs(tile_pairs(tiles(rows, labels, sets, rule), rule))
        return keep(links.unionByName(confirmed(pairs, sets, rule)))


def near_components(docs: DataFrame, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """``doc, body, n, component`` of every row: its document key, the hash of its text, the size
    of its set, and the smallest key that links lead to, its own included.

    A row without text or words has an empty set and is linked with nothing. Rows that share an id
    are one document, linked by what any of them holds; rows without an id are documents of their
    own, told apart by their text. Any number of equal sets are linked through one of them.
    """
    spark = docs.sparkSession
    with inner_tables(spark) as keep:
        signed = stored(signatures(docs, rule))
        classes, rows = candidate_classes(signed, rule, keep)
        # Written, so that the join reads two plain tables and Spark can split the task of many copies.
        names = stored(signed.groupBy("h1", "h2").agg(F.min("doc").alias("class")))
        found = keep(signed.drop("start").join(names, ["h1", "h2"]).drop("h1", "h2"))
    links = near_links(docs, classes, rows, rule)
    held = found.where("n > 0").groupBy("doc").agg(F.min("class").alias("a"), F.max("class").alias("b"))
    held = found.join(held.where("a < b").select("doc", "a"), "doc").select("a", F.col("class").alias("b"))
    labels = components(links.unionByName(held)).toDF("class", "label")
    found = found.join(labels, "class", "left")
    lone = F.col("n") == 0
    return found.select(
        "doc",
        "body",
        "n",
        F.when(lone, F.col("doc")).otherwise(F.coalesce("label", "class")).alias("component"),
    )


def keep_one(docs: DataFrame, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. Rows that repeat
    an id and its text are one document; other columns do not matter."""
    kept = near_components(docs, rule).where("doc = component").select("doc", "body").distinct()
    rows = docs.withColumns({"__doc": document_key(), "__body": F.xxhash64("text")})
    kept = kept.toDF("__doc", "__body")
    rows = rows.join(kept, ["__doc", "__body"], "left_semi")
    once = F.row_number().over(Window.partitionBy("__doc", "__body").orderBy("__doc", "__body"))
    return rows.withColumn("__once", once).where("__once = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def component_report(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    found = near_components(docs.select("doc_id", "text"), rule)
    return found.select(
        key_or_null(F.col("doc")).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        key_or_null(F.col("component")).alias("component_id"),
    )
