"""Alignment of two tokenizers over the bytes of the same text.

A is a byte-level BPE vocabulary (a JSON file of the tokenizers library), B a sentencepiece model.
Both token sequences cover the same bytes. Byte offsets at which tokens of both end cut them into
groups; an A token and a B token are linked where their bytes overlap.

Long texts go as fragments. The tokens that end in one byte range of a document make a fragment: an
open prefix up to the first common end, closed groups, and an open suffix after the last one.
Fragments compose associatively (the left one's suffix and the right one's prefix are one more
group), so the ranges of a very long document are tokenized in different tasks and composed in a
tree of byte ranges, each level one shuffle. Closed groups are left behind as segments; only the
open ends move up the tree.

Shorter texts, and the segments, are summed in blocks: a block's texts are rows of indexes into the
block's own dictionary of units (a unit is what stands between two places at which no token of
either vocabulary can reach across), and every unit is tokenized and aligned once. What the corpus
has to say about a link, how often its pair of ids is linked anywhere, comes back to each block as
one number per pair of its dictionary.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.bpe import ANYTHING, LONG_RUN
from barloom.llm.common import sequence, stored

#: No token reaches from a character that is no white space over a following space: the pattern of A
#: matches no white space after anything else, and no piece of B has a space after another sign.
CUT = re.compile(r"(?<=\S)(?= +\S)")
ID = "<i4"
SPACE = "▁"


@dataclass(frozen=True)
class Pair:
    """Files of the two vocabularies, as they lie on every executor, and the pattern of A."""

    byte_level: str
    pieces: str
    pattern: str


@dataclass(frozen=True)
class Sizes:
    """Bytes of a text from which it goes as fragments, of a range, of a block's texts; ``fan``
    ranges make one range of the next level."""

    long: int = 1 << 16
    range: int = 1 << 15
    block: int = 8 << 20
    fan: int = 32


def byte_signs() -> dict[str, int]:
    """The printable signs that stand for bytes in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + n): b for n, b in enumerate(others)}}


class Vocabularies:
    """Both encoders, and the bytes of every id."""

    def __init__(self, pair: Pair):
        with open(pair.byte_level, encoding="utf-8") as text:
            model = json.load(text)["model"]
        signs = byte_signs()
        ranks = {}
        for entry, rank in model["vocab"].items():
            if all(c in signs for c in entry):
                ranks[bytes(signs[c] for c in entry)] = rank
        known = {entry: bytes(signs.get(c, 0) for c in entry) for entry in model["vocab"]}
        merged = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        order = [ranks[known[a] + known[b]] for a, b in merged]
        if any(x >= y for x, y in zip(order, order[1:])):
            raise ValueError("the merges of A are not in the order of its ids")
        single = {k: v for k, v in ranks.items() if len(k) == 1}
        usable = {**single, **{known[a] + known[b]: ranks[known[a] + known[b]] for a, b in merged}}
        # Ids without a merge of their own stay out, and their places are taken by what cannot occur.
        spare = (b"\xff\xff" + n.to_bytes(4, "big") for n in itertools.count())
        taken = set(usable.values())
        filled = {next(spare): n for n in range(max(taken) + 1) if n not in taken}
        self.a = tiktoken.Encoding("a", pat_str=pair.pattern, mergeable_ranks={**usable, **filled}, special_tokens={})
        self.a_run = tiktoken.Encoding("run", pat_str=ANYTHING, mergeable_ranks={**usable, **filled}, special_tokens={})
        self.a_bytes = [b"\xff"] * (max(taken) + 1)
        for entry, n in usable.items():
            self.a_bytes[n] = entry
        self.b = sentencepiece.SentencePieceProcessor(model_file=pair.pieces)
        self.b_bytes = []
        for n in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(n)
            if self.b.is_byte(n):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(n) or self.b.is_unknown(n):
                self.b_bytes.append(b"\xff")  # in no text
            else:
                self.b_bytes.append(piece.replace(SPACE, " ").encode())
        pieces = map(self.b.id_to_piece, range(self.b.vocab_size()))
        if any(x != SPACE and y == SPACE for p in pieces for x, y in zip(p, p[1:])):
            raise ValueError("a piece of B has a space after another sign")
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)

    def encode_a(self, text: str) -> list[int]:
        """Ids of A; white space runs too long for the library's matcher are cut as its pattern cuts
        them, the last character going with what follows."""
        ids, start = [], 0
        for run in LONG_RUN.finditer(text):
            first, last = run.span()
            stop = last if last == len(text) else last - 1
            ids += self.a.encode_ordinary(text[start:first])
            ids += self.a_run.encode_ordinary(text[first:stop])
            start = stop
        return ids + self.a.encode_ordinary(text[start:])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a text that begins with the space B adds; None where either one's bytes
        are not those of the text."""
        a, b = self.encode_a(text), self.b.encode(text[1:], num_threads=1)
        data = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data:
            return None
        if b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


@functools.cache
def vocabularies(pair: Pair) -> Vocabularies:
    return Vocabularies(pair)


@dataclass
class Aligned:
    """Two token runs over the same bytes. A link ends at ``link_end`` and holds the A token
    ``link_a`` and the B token ``link_b`` (places in the runs); a group ends at ``cut``, before the
    tokens ``cut_a`` and ``cut_b``."""

    link_end: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def align(a_end: np.ndarray, b_end: np.ndarray) -> Aligned:
    """From the rising byte offsets at which the tokens end. Between two neighbouring ends there is
    one A and one B token, and every overlapping pair shares exactly one such stretch."""
    ends = np.concatenate([a_end, b_end])
    ends.sort(kind="stable")
    new = np.ones(len(ends), dtype=bool)
    new[1:] = ends[1:] != ends[:-1]
    both = np.zeros(len(ends), dtype=bool)
    both[:-1] = ~new[1:]
    cut = ends[new & both]
    link_end = ends[new]
    return Aligned(
        link_end,
        np.searchsorted(a_end, link_end),
        np.searchsorted(b_end, link_end),
        cut,
        np.searchsorted(a_end, cut) + 1,
        np.searchsorted(b_end, cut) + 1,
    )


def marked_ids(a: np.ndarray, b: np.ndarray, found: Aligned) -> tuple[list[str], np.ndarray]:
    """``a1,`` ``a2|`` ``b1;`` ...: every id with the sign after it, in the order of the groups, and
    how many ids there are up to the end of each group."""
    group_a = np.searchsorted(found.cut_a, np.arange(len(a)), side="right")
    group_b = np.searchsorted(found.cut_b, np.arange(len(b)), side="right")
    before_b = np.concatenate([[0], found.cut_b])
    out = np.empty(len(a) + len(b), dtype=object)
    last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    last_a[found.cut_a - 1] = True
    last_b[found.cut_b - 1] = True
    out[np.arange(len(a)) + before_b[group_a]] = [f"{n}|" if x else f"{n}," for n, x in zip(a.tolist(), last_a.tolist())]
    out[np.arange(len(b)) + found.cut_a[group_b]] = [f"{n};" if x else f"{n}," for n, x in zip(b.tolist(), last_b.tolist())]
    return out.tolist(), found.cut_a + found.cut_b


# --- fragments -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Run:
    """Ids of both vocabularies side by side, and the byte at which they begin."""

    start: int
    a: tuple[int, ...] = ()
    b: tuple[int, ...] = ()

    def __add__(self, other: Run) -> Run:
        return Run(self.start, self.a + other.a, self.b + other.b)


@dataclass(frozen=True)
class Fragment:
    """Tokens that end in one stretch of bytes. Without a common end (``suffix`` None) all of them
    are in ``prefix``. ``closed`` holds whole groups, as runs in order."""

    prefix: Run
    closed: tuple[Run, ...] = ()
    suffix: Run | None = None

    def __mul__(self, right: Fragment) -> Fragment:
        if self.suffix is None:
            return Fragment(self.prefix + right.prefix, right.closed, right.suffix)
        if right.suffix is None:
            return Fragment(self.prefix, self.closed, self.suffix + right.prefix)
        seam = self.suffix + right.prefix
        return Fragment(self.prefix, (*self.closed, seam, *right.closed), right.suffix)


def fragment(start: int, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> Fragment:
    """The fragment of the given tokens, which end after ``start``."""
    found = align(a_end, b_end)
    ids_a, ids_b = a.tolist(), b.tolist()
    if not len(found.cut):
        return Fragment(Run(start, tuple(ids_a), tuple(ids_b)))
    first_a, first_b, last_a, last_b = found.cut_a[0], found.cut_b[0], found.cut_a[-1], found.cut_b[-1]
    body = Run(int(found.cut[0]), tuple(ids_a[first_a:last_a]), tuple(ids_b[first_b:last_b]))
    return Fragment(
        Run(start, tuple(ids_a[:first_a]), tuple(ids_b[:first_b])),
        (body,) if body.a else (),
        Run(int(found.cut[-1]), tuple(ids_a[last_a:]), tuple(ids_b[last_b:])),
    )


def fragments_of(start: int, ids: tuple[np.ndarray, np.ndarray], known: Vocabularies, width: int) -> list[Fragment]:
    """The tokens of a piece of text that begins at byte ``start``, by the range they end in."""
    a, b = ids
    a_end, b_end = start + np.cumsum(known.a_size[a]), start + np.cumsum(known.b_size[b])
    out = []
    for n in range(start // width, (int(a_end[-1]) - 1) // width + 1):
        cuts = [np.searchsorted(e, [n * width, (n + 1) * width], side="right") for e in (a_end, b_end)]
        (a0, a1), (b0, b1) = cuts
        if a1 > a0 or b1 > b0:
            out.append(fragment(max(start, n * width), a[a0:a1], a_end[a0:a1], b[b0:b1], b_end[b0:b1]))
    return out


FRAGMENTS = (
    "key long, start long, closed boolean, a binary, b binary, cut long, next_a binary, next_b binary, ok boolean"
)


def packed(ids: tuple[int, ...]) -> bytes:
    return np.array(ids, dtype=ID).tobytes()


def unpacked(ids: bytes) -> tuple[int, ...]:
    return tuple(np.frombuffer(ids, dtype=ID).tolist())


def rows_of(key: int, x: Fragment) -> list[tuple]:
    """The closed groups as segments, then what is open: prefix, and suffix with its first byte."""
    rows = [(key, run.start, True, packed(run.a), packed(run.b), None, None, None, True) for run in x.closed]
    ends = (None, None, None) if x.suffix is None else (x.suffix.start, packed(x.suffix.a), packed(x.suffix.b))
    return [*rows, (key, x.prefix.start, False, packed(x.prefix.a), packed(x.prefix.b), *ends, True)]


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


FRAGMENT_TYPES = pa.schema(
    [
        ("key", pa.int64()), ("start", pa.int64()), ("closed", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()),
        ("cut", pa.int64()), ("next_a", pa.binary()), ("next_b", pa.binary()), ("ok", pa.bool_()),
    ]
)


def pieces(docs: DataFrame, size: int) -> DataFrame:
    """``key, doc_id, start, text``: the texts, each behind the space that B adds, cut where no token
    reaches across into pieces of ``size`` bytes or a little more. ``key`` tells rows apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                number, text, at, start = number + 1, f" {text}", 0, 0
                while at < len(text):
                    place = CUT.search(text, at + size)
                    stop = place.start() if place else len(text)
                    piece = text[at:stop]
                    data = len(piece.encode())
                    yield pa.RecordBatch.from_pydict(
                        {"key": [number], "doc_id": pa.array([doc], pa.int64()), "start": [start], "text": [piece]}
                    )
                    at, start = stop, start + data

    return docs.select("doc_id", "text").mapInArrow(cut, "key long, doc_id long, start long, text string")


def encoded_fragments(parts: DataFrame, pair: Pair, width: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(pair)
        for batch in batches:
            for key, start, text in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "text"))):
                ids = known.encode(text)
                if ids is None:
                    yield arrow_rows([(key, start, False, b"", b"", None, None, None, False)], FRAGMENT_TYPES)
                    continue
                found = fragments_of(start, ids, known, width)
                yield arrow_rows([r for x in found for r in rows_of(key, x)], FRAGMENT_TYPES)

    return parts.select("key", "start", "text").mapInArrow(encode, FRAGMENTS)


def compose(group: pa.Table) -> pa.Table:
    """All fragments of one range of a document, composed in the order of their bytes."""
    rows = sorted(group.to_pylist(), key=lambda r: r["start"])
    found = None
    for r in rows:
        suffix = None if r["cut"] is None else Run(r["cut"], unpacked(r["next_a"]), unpacked(r["next_b"]))
        x = Fragment(Run(r["start"], unpacked(r["a"]), unpacked(r["b"])), (), suffix)
        found = x if found is None else found * x
    return pa.Table.from_batches([arrow_rows(rows_of(rows[0]["key"], found), FRAGMENT_TYPES)])


def segments(parts: DataFrame, pair: Pair, sizes: Sizes) -> DataFrame:
    """``key, start, a, b``: aligned runs of ids that follow one another and make up the texts.

    Texts with a piece whose bytes do not come back have none.
    """
    longest = parts.agg(F.max(F.col("start") + F.octet_length("text"))).first()[0] or 0
    found = stored(encoded_fragments(parts.repartition("key", "start"), pair, sizes.range))
    wrong = found.where(~F.col("ok")).select("key").distinct()
    found = stored(found.join(wrong, "key", "left_anti"), ["closed"])
    whole = found.where("closed").select("key", "start", "a", "b")
    width = sizes.range
    while True:
        level = found.where(~F.col("closed")).withColumn("range", F.expr(f"start div {width}"))
        step = level.groupBy("key", "range").applyInArrow(lambda g: compose(g.drop_columns(["range"])), FRAGMENTS)
        found = stored(step, ["closed"])
        whole = whole.unionByName(found.where("closed").select("key", "start", "a", "b"))
        if width >= longest:
            break
        width *= sizes.fan
    # What is left open is the first group of each text, for the last byte is an end of both.
    return whole.unionByName(found.where(~F.col("closed")).select("key", "start", "a", "b"))


# --- blocks --------------------------------------------------------------------------------------

BLOCKS = (
    "dictionary boolean, block long, key long, doc_id long, n_a long, n_b long, n_groups long, n_links long,"
    " groups_sha256 string, units binary, offsets binary, links binary, pairs array<long>, counts array<long>"
)
BLOCK_TYPES = pa.schema(
    [
        ("dictionary", pa.bool_()), ("block", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()),
        ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups_sha256", pa.string()), ("units", pa.binary()), ("offsets", pa.binary()), ("links", pa.binary()),
        ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ]
)


def block_batch(**columns) -> pa.RecordBatch:
    """Rows with the given columns; the others are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[t.name], t.type) if t.name in columns else pa.nulls(n, t.type) for t in BLOCK_TYPES],
        schema=BLOCK_TYPES,
    )


def dictionary_row(block: int, per_unit: np.ndarray, pairs: np.ndarray, uses: np.ndarray) -> pa.RecordBatch:
    """One row for a block: the pairs it holds, how often each is linked in it, and the links of each
    unit as places among the pairs. ``per_unit`` counts the links, ``uses`` the unit's occurrences."""
    found, places = np.unique(pairs, return_inverse=True)
    counts = np.bincount(places, weights=np.repeat(uses, per_unit), minlength=len(found))
    offsets = np.concatenate([[0], np.cumsum(per_unit)])
    return block_batch(
        dictionary=[True],
        block=[block],
        offsets=[offsets.astype(ID).tobytes()],
        links=[places.astype(ID).tobytes()],
        pairs=[found],
        counts=[counts.astype(np.int64)],
    )


@dataclass
class Units:
    """A block's dictionary: every unit is tokenized and aligned once."""

    known: Vocabularies
    places: dict[str, int] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)

    def add(self, units: list[str]) -> None:
        """Units that are not yet known. Those that end in a sign are tokenized as one text, since
        they stay apart in it; a unit that ends in white space stands alone."""
        plain = [u for u in units if not u[-1].isspace()]
        if plain and not self._add(plain):
            for unit in plain:
                self._add([unit]) or self._wrong(unit)
        for unit in units:
            if unit[-1].isspace():
                self._add([unit]) or self._wrong(unit)

    def _wrong(self, unit: str) -> None:
        self.places[unit] = len(self.texts)
        self.texts.append("")
        self.sums.append(np.zeros((1, 5), dtype=np.int64))

    def _add(self, units: list[str]) -> bool:
        ids = self.known.encode("".join(units))
        if ids is None:
            return False
        a, b = ids
        a_end, b_end = np.cumsum(self.known.a_size[a]), np.cumsum(self.known.b_size[b])
        unit_end = np.cumsum([len(u.encode()) for u in units])
        found = align(a_end, b_end)
        marked, group_ends = marked_ids(a, b, found)
        last_group = np.searchsorted(found.cut, unit_end)
        ends = group_ends[last_group].tolist()
        joined = ["".join(marked[s:e])[:-1] for s, e in zip([0, *ends], ends)]
        tops = [found.cut_a[last_group], found.cut_b[last_group], last_group + 1]
        tops.append(np.searchsorted(found.link_end, unit_end, side="right"))
        sums = np.diff(np.stack(tops, axis=1), axis=0, prepend=0)
        first = len(self.texts)
        self.places.update(zip(units, range(first, first + len(units))))
        self.texts += joined
        self.sums.append(np.concatenate([sums, np.ones((len(units), 1), dtype=np.int64)], axis=1))
        self.pairs.append(a[found.link_a] * len(self.known.b_bytes) + b[found.link_b])
        return True


def text_blocks(docs: DataFrame, pair: Pair, sizes: Sizes) -> DataFrame:
    """Rows of texts and of dictionaries, by blocks of neighbouring texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = vocabularies(pair), (TaskContext.get().partitionId() << 24) - 1
        units, used = None, 0
        uses: list[np.ndarray] = []

        def closing() -> pa.RecordBatch:
            total = np.bincount(np.concatenate(uses), minlength=len(units.texts))
            links = np.concatenate(units.sums)[:, 3]
            pairs = np.concatenate([np.empty(0, dtype=np.int64), *units.pairs])
            return dictionary_row(block, links, pairs, total)

        for batch in batches:
            if units is None:
                units, used, uses, block = Units(known), 0, [], block + 1
            texts = [f" {t}" if t else "" for t in batch.column("text").to_pylist()]
            split = [CUT.split(t) if t else [] for t in texts]
            missing = dict.fromkeys(itertools.chain.from_iterable(split))
            missing = [u for u in missing if u not in units.places]
            if missing:
                units.add(missing)
            counts = np.array([len(s) for s in split], dtype=np.int64)
            flat = itertools.chain.from_iterable(split)
            place = np.fromiter(map(units.places.__getitem__, flat), dtype=np.int64, count=int(counts.sum()))
            owner, _ = sequence(counts)
            sums = np.concatenate([np.zeros((0, 5), dtype=np.int64), *units.sums])
            units.sums = [sums]
            right = np.bincount(owner, weights=sums[place, 4], minlength=len(texts)) == counts
            place, owner = place[right[owner]], owner[right[owner]]
            kept = np.where(right, counts, 0)
            totals = [np.bincount(owner, weights=sums[place, n], minlength=len(texts)).astype(np.int64) for n in range(4)]
            stops = np.cumsum(kept).tolist()
            listed, names = place.tolist(), units.texts
            digests, rows = [], []
            for start, stop in zip([0, *stops], stops):
                text = ";".join([names[n] for n in listed[start:stop]])
                digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
                rows.append(place[start:stop].astype(ID).tobytes())
            uses.append(place)
            used += sum(map(len, texts))
            yield block_batch(
                dictionary=[False] * len(texts),
                block=[block] * len(texts),
                doc_id=batch.column("doc_id"),
                n_a=totals[0],
                n_b=totals[1],
                n_groups=totals[2],
                n_links=totals[3],
                groups_sha256=digests,
                units=rows,
            )
            if used >= sizes.block:
                yield closing()
                units = None
        if units is not None:
            yield closing()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, BLOCKS)


def segment_blocks(runs: DataFrame, pair: Pair, sizes: Sizes) -> DataFrame:
    """The same rows for segments. The units of their dictionary are single links."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(pair)
        # Apart from the blocks of texts.
        block = -1 - (TaskContext.get().partitionId() << 24)
        for batch in batches:
            if not batch.num_rows:
                continue
            found, sums = [], []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = (np.frombuffer(x, dtype=ID).astype(np.int64) for x in (a, b))
                x = align(np.cumsum(known.a_size[a]), np.cumsum(known.b_size[b]))
                found.append(a[x.link_a] * len(known.b_bytes) + b[x.link_b])
                sums.append((len(a), len(b), len(x.cut), len(x.link_end)))
            pairs, place = np.unique(np.concatenate(found), return_inverse=True)
            stops = np.cumsum([len(x) for x in found]).tolist()
            yield block_batch(
                dictionary=[False] * len(sums),
                block=[block] * len(sums),
                key=batch.column("key"),
                **{n: [s[k] for s in sums] for k, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                units=[place[s:e].astype(ID).tobytes() for s, e in zip([0, *stops], stops)],
            )
            yield dictionary_row(block, np.ones(len(pairs), dtype=np.int64), pairs, np.bincount(place))
            block -= 1

    return runs.select("key", "a", "b").mapInArrow(build, BLOCKS)


def segment_digests(runs: DataFrame, pair: Pair) -> DataFrame:
    """``key, groups_sha256``. The segments of a text pass through one task in order, a batch at a
    time, for that is how a digest is made; the text of the groups is never held as a whole."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, current, state = vocabularies(pair), None, None
        for batch in batches:
            for key, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b"))):
                a, b = (np.frombuffer(x, dtype=ID).astype(np.int64) for x in (a, b))
                marked, _ = marked_ids(a, b, align(np.cumsum(known.a_size[a]), np.cumsum(known.b_size[b])))
                text = "".join(marked)[:-1].encode()
                if key == current:
                    state.update(b";" + text)
                    continue
                if current is not None:
                    yield pa.RecordBatch.from_pydict({"key": [current], "groups_sha256": [state.hexdigest()]})
                current, state = key, hashlib.sha256(text)
        if current is not None:
            yield pa.RecordBatch.from_pydict({"key": [current], "groups_sha256": [state.hexdigest()]})

    rows = runs.repartition("key").sortWithinPartitions("key", "start")
    return rows.select("key", "a", "b").mapInArrow(digest, "key long, groups_sha256 string")


# --- the corpus ----------------------------------------------------------------------------------

SCORED = (
    "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
    " groups_sha256 string"
)
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pair_counts(blocks: DataFrame, b_ids: int) -> tuple[DataFrame, DataFrame]:
    """``block, place, pair`` of every dictionary, and ``pair, n, best``: how many links of the corpus
    hold the pair, and 1 where no other pair of its B id has more."""
    listed = blocks.where("dictionary").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x"))
    listed = stored(listed.select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n")))
    total = stored(listed.groupBy("pair").agg(F.sum("n").alias("n")))
    most = total.groupBy(F.expr(f"pair % {b_ids}").alias("b")).agg(F.max("n").alias("most"))
    total = total.withColumn("b", F.expr(f"pair % {b_ids}")).join(most, "b")
    return listed.drop("n"), total.select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def scored_block(texts: pa.Table, found: pa.Table) -> pa.Table:
    """``count_sum`` and ``n_best`` of the texts of a block, from the numbers of its pairs."""
    own = texts.filter(texts["dictionary"]).to_pylist()[0]
    rows = texts.filter(pa.compute.invert(texts["dictionary"]))
    offsets, links = (np.frombuffer(own[c], dtype=ID) for c in ("offsets", "links"))
    per_unit = np.zeros((2, len(offsets)), dtype=np.int64)
    for n, name in enumerate(("n", "best")):
        of_pair = np.zeros(len(found), dtype=np.int64)
        of_pair[found["place"].to_numpy()] = found[name].to_numpy()
        running = np.concatenate([[0], np.cumsum(of_pair[links])])
        per_unit[n, :-1] = np.diff(running[offsets])
    sums = [per_unit[:, np.frombuffer(u, dtype=ID)].sum(axis=1).tolist() for u in rows["units"].to_pylist()]
    columns = {t.split()[0]: None for t in SCORED.split(", ")}
    for name in columns:
        if name in ("n_best", "count_sum"):
            columns[name] = pa.array([s[name == "n_best"] for s in sums], pa.int64())
        else:
            columns[name] = rows[name]
    return pa.table(columns)


def alignment_report(docs: DataFrame, pair: Pair, sizes: Sizes = Sizes()) -> DataFrame:
    """Per row of ``docs``: tokens of A and B, groups, links, and what the corpus says of the links.

    ``n_best`` counts the links whose pair is the most frequent one of its B id, ties included;
    ``count_sum`` adds up how often the pairs are linked in all texts. Every row stands alone, so
    repeated rows are counted and returned as often as they occur, whatever their ids. A text that
    is null or empty, or whose tokens of either kind do not give back its bytes, has no tokens: all
    numbers are 0 and the digest is ''. An empty table gives no rows; other columns are not read. A
    text of any length is cut only where no token reaches across; a stretch without such a place (a
    space between signs) is tokenized in one task.
    """
    known = vocabularies(pair)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    parts = stored(pieces(docs.where(size > sizes.long), sizes.long))
    runs = stored(segments(parts, pair, sizes))
    blocks = text_blocks(docs.where(size <= sizes.long), pair, sizes)
    blocks = stored(blocks.unionByName(segment_blocks(runs, pair, sizes)), ["dictionary"])
    listed, counts = pair_counts(blocks, len(known.b_bytes))
    found = listed.join(counts, "pair").select("block", "place", "n", "best")
    scored = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(scored_block, SCORED)
    scored = stored(scored)
    short = scored.where("key is null").select(*COLUMNS)
    sums = [F.sum(c).alias(c) for c in COLUMNS[1:-1]]
    longer = scored.where("key is not null").groupBy("key").agg(*sums).join(segment_digests(runs, pair), "key")
    longer = parts.select("key", "doc_id").distinct().join(longer, "key", "left")
    return short.unionByName(
        longer.select(
            "doc_id",
            *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COLUMNS[1:-1]],
            F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
        )
    )
