"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import itertools
import os

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import products_made, remove_products, shared_folder

WHITE = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of a batch that goes to Python, at most.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 512,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
}
#: Stands for a null doc_id inside the operators: the smallest id.
NO_ID = -(2**63)


def stored(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a step's result to the shared folder and return the written table.

    The step's shuffle files go when it ends, so a job of many steps never holds more than the
    shuffles of one; its result survives the loss of any executor.
    """
    return written(df, shared_folder(df.sparkSession), partition_by)


def written(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def inner_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``stored`` writes inside the block are deleted at its end. The function given to
    the block writes those that stay, which must hold all that is used later. After an error
    everything stays, for whoever clears the session's products."""
    since, kept = products_made(spark), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(shared_folder(spark))
        return written(df, kept[-1])

    yield keep
    remove_products(spark, since, kept)


def prepared(spark: SparkSession) -> SparkSession:
    """The session, set up for Python functions over whole texts.

    Texts cross to Python in batches that stay small however long they are. Workers look for this
    package where the driver has it, besides their own path; on a cluster it is installed or sent
    along with --py-files, and the extra entry finds nothing.
    """
    for name, most in BATCH.items():
        spark.conf.set(name, str(most))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
    return spark


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def id_or_smallest(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID).cast("long"))


def id_or_null(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value != F.lit(NO_ID).cast("long"), value)


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, so that arrays over the
    words of a slice stay small whatever the length of the documents."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(sizes.astype(np.int64)) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null text is an empty one."""
    return [x or "" for x in batch.column(column).to_pylist()]


def with_length(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns asked for; ``n_chars``, if among them, counts the code points of the text."""
    return docs.select(
        *[
            F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c)
            if c == "n_chars"
            else F.col(f"`{c}`")
            for c in columns
        ]
    )


def document_key(column: str = "doc_id", text: str = "text") -> Column:
    """The id as a long. A row without an id is a document of its own, told apart by its text: its
    key is a hash of the text moved below all ids in use."""
    hashed = F.pmod(F.xxhash64(text), F.lit(2**62)) + F.lit(NO_ID).cast("long")
    return F.coalesce(F.col(column).cast("long"), hashed)


def key_or_null(key: Column) -> Column:
    """The doc_id behind a document key."""
    return F.when(key >= F.lit(NO_ID + 2**62), key)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    BOUND = 1 << 16

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_arrays(texts: Sequence[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after the other, and each text's number of words.

    ``bytes.split`` cuts at exactly the white space that words never hold.
    """
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = itertools.chain.from_iterable(words)
    hashes = np.fromiter(map(known.__getitem__, flat), dtype=np.uint64, count=int(counts.sum()))
    return hashes, counts


def scrambled(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of a 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of the given lengths laid end to end: the piece of each element, its place in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - starts[owner]
