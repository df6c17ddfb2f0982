"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is a path that exists on every executor, as an installed package's file does. Each
worker process builds its encoder once. Ids are kept as little-endian unsigned 32-bit integers in
one binary column, so a text of any length stays one value.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pandas as pd
import tiktoken

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = "<u4"
#: A text is cut where a letter, digit or sign of ASCII stands before a space or line break: there
#: every match of the pattern ends, because none holds white space after anything else.
SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")
#: White space runs longer than this are matched here: the library's matcher recurses over them.
LONG_RUN = re.compile(r"\s{10000,}")
PIECE = 1 << 16
#: A pattern of one match, for text that is one match of the real pattern.
ANYTHING = "(?s:.+)"


@functools.cache
def encoder(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file: a line per token, its bytes in base64 and its rank."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        name=rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at safe boundaries into pieces of ``size`` code points or a little more.

    Without a boundary a piece is as long as it must be.
    """
    out, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def encode_piece(rank_file: str, pattern: str, piece: str) -> list[int]:
    """Ids of a piece; runs of white space too long for the library's matcher are cut as the
    pattern cuts them: a run before anything else gives its last character to what follows."""
    codec, whole = encoder(rank_file, pattern), encoder(rank_file, ANYTHING)
    ids, start = [], 0
    for run in LONG_RUN.finditer(piece):
        first, last = run.span()
        stop = last if last == len(piece) else last - 1
        ids += codec.encode_ordinary(piece[start:first])
        ids += whole.encode_ordinary(piece[first:stop])
        start = stop
    return ids + codec.encode_ordinary(piece[start:])


def encode_text(rank_file: str, pattern: str, text: str) -> bytes:
    ids = [i for piece in pieces(text) for i in encode_piece(rank_file, pattern, piece)]
    return np.array(ids, dtype=ID).tobytes()


def encoded(text: Column, rank_file: str, pattern: str) -> Column:
    """Ids of a text column as binary; a null or empty text has none (zero bytes)."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([encode_text(rank_file, pattern, t or "") for t in texts], dtype=object)

    return encode(text)


def decoded(ids: Column, rank_file: str, pattern: str) -> Column:
    """Raw bytes of an id column; they need not be valid UTF-8 if the ids were cut. Null: none."""

    @F.pandas_udf("binary")
    def decode(columns: pd.Series) -> pd.Series:
        codec = encoder(rank_file, pattern)
        return pd.Series(
            [codec.decode_bytes(np.frombuffer(b or b"", dtype=ID).tolist()) for b in columns],
            dtype=object,
        )

    return decode(ids)


def encode_documents(
    docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "token_ids"
) -> DataFrame:
    """All columns of ``docs`` and the ids of its text; a column already named ``ids`` is replaced."""
    return docs.withColumn(ids, encoded(F.col(text), rank_file, pattern))


def decode_documents(
    docs: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", into: str = "bytes"
) -> DataFrame:
    return docs.withColumn(into, decoded(F.col(ids), rank_file, pattern))


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Count and digests of the ids of every row's text, and the digest of the bytes they give back.

    Each row stands alone: repeated rows give repeated results, an empty or null text gives 0 ids,
    an empty table gives none, other columns are not read.
    """
    rows = encode_documents(docs.select("doc_id", "text"), rank_file, pattern)
    rows = decode_documents(rows.select("doc_id", "token_ids"), rank_file, pattern)
    return rows.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
