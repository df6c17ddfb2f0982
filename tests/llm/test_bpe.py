import random

import numpy as np
import public_tokenizers
import pytest

from barloom.llm import bpe
from brute import sha

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def expected(text):
    return bpe.encoder(RANKS, PATTERN).encode_ordinary(text or "")


def test_cutting_a_text_changes_no_id(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_RUN", bpe.re.compile(r"\s{5,}"))
    dealt = random.Random(7)
    parts = ["a", "b'll", "'s", " ", "  ", "\n", "\t", "é", "5", ".", "\u3000", "😀", "'", "the ", "\r\n", " " * 6]
    for _ in range(3000):
        text = "".join(dealt.choices(parts, k=dealt.randint(0, 60)))
        ids = [i for p in bpe.pieces(text, 20) for i in bpe.encode_piece(RANKS, PATTERN, p)]
        assert ids == expected(text), text


@pytest.mark.parametrize("text", ["a" + " " * 1_500_000 + "b  ", "x" * 300_000, "é\n" * 200_000])
def test_long_runs_come_back(text):
    ids = bpe.encode_text(RANKS, PATTERN, text)
    assert bpe.encoder(RANKS, PATTERN).decode_bytes(np.frombuffer(ids, "<u4").tolist()) == text.encode()


def test_table_matches_the_library(odd_docs, no_docs):
    found = sorted(map(tuple, bpe.digests(odd_docs, RANKS, PATTERN).collect()), key=str)
    rows = [(r.doc_id, expected(r.text), r.text or "") for r in odd_docs.select("doc_id", "text").collect()]
    want = [(d, len(i), sha(np.array(i, "<u4").tobytes()), sha(t)) for d, i, t in rows]
    assert found == sorted(want, key=str)
    assert bpe.digests(no_docs, RANKS, PATTERN).count() == 0


def test_operators_keep_other_columns(odd_docs):
    rows = bpe.decode_documents(bpe.encode_documents(odd_docs, RANKS, PATTERN), RANKS, PATTERN)
    assert set(odd_docs.columns) <= set(rows.columns)
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in rows.select("text", "bytes").collect())
