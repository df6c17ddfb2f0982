import hashlib
import random

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tokenizers import Tokenizer

from barloom.llm import alignment as al

PAIR = al.Pair(
    public_tokenizers.path("byte_bpe_50k.json"),
    public_tokenizers.path("piece_bpe_32k.model"),
    public_tokenizers.PATTERN,
)


def loaded():
    tok = Tokenizer.from_file(PAIR.byte_level)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=PAIR.pieces)


def plain_tokens(text, tok, sp):
    """(id, bytes) of both libraries, or None where the bytes do not come back."""
    if not text:
        return None
    signs = al.byte_signs()
    a = [(e.id, bytes(signs[c] for c in tok.id_to_token(e.id))) for e in map(Plain, tok.encode(" " + text, add_special_tokens=False).ids)]
    b = []
    for n in sp.encode(text):
        piece = sp.id_to_piece(n)
        b.append((n, bytes([int(piece[3:5], 16)]) if sp.is_byte(n) else piece.replace("▁", " ").encode()))
    data = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == data == b"".join(x for _, x in b) else None


class Plain:
    def __init__(self, n):
        self.id = n


def walked(a, b):
    """Groups and links, token by token."""
    groups, links, i, j = [], [], 0, 0
    end_a, end_b, own_a, own_b = len(a[0][1]), len(b[0][1]), [a[0][0]], [b[0][0]]
    while True:
        links.append((a[i][0], b[j][0]))
        if end_a == end_b:
            groups.append((own_a, own_b))
            i, j = i + 1, j + 1
            if i == len(a):
                return groups, links
            end_a, end_b, own_a, own_b = end_a + len(a[i][1]), end_b + len(b[j][1]), [a[i][0]], [b[j][0]]
        elif end_a < end_b:
            i += 1
            end_a += len(a[i][1])
            own_a.append(a[i][0])
        else:
            j += 1
            end_b += len(b[j][1])
            own_b.append(b[j][0])


def text_of(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def plain_report(docs):
    tok, sp = loaded()
    seen, counts = [], Counter()
    for doc, text in docs:
        tokens = plain_tokens(text, tok, sp)
        groups, links = walked(*tokens) if tokens else ([], [])
        counts.update(links)
        seen.append((doc, tokens or ((), ()), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc, (a, b), groups, links in seen:
        digest = hashlib.sha256(text_of(groups).encode()).hexdigest() if groups else ""
        found = [counts[x] for x in links]
        out.append((doc, len(a), len(b), len(groups), len(links), sum(n == best[x[1]] for n, x in zip(found, links)), sum(found), digest))
    return sorted(out, key=str)


ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b is not a space", "  two  spaces ", " ", "\n", "x \n y", "tail  ",
    "a\x00b \x1c c\x85d", "　wide　 space", "I'll we've 'tis", "1234567890 " * 9, "漢字" * 300, "é \U0001f600\U0001f468‍\U0001f469",
    "word" * 400 + " end", " " * 700 + "z", "﻿bom �",
]


@pytest.mark.parametrize("sizes", [al.Sizes(), al.Sizes(long=40, range=256, block=2_000, fan=8)])
def test_matches_plain_alignment(spark, odd_texts, sizes):
    texts = [t if t is None or len(t) < 20_000 else t[:9_000] for t in odd_texts] + ODD
    rows = [(None if i % 7 == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, al.alignment_report(docs, PAIR, sizes).collect()), key=str)
    assert found == plain_report(rows)


def test_long_text_and_clashing_columns(odd_docs, no_docs):
    report = al.alignment_report(odd_docs, PAIR)
    assert report.columns == list(al.COLUMNS)
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, report.collect()), key=str) == plain_report(rows)
    assert al.alignment_report(no_docs, PAIR).count() == 0


def test_a_bad_piece_takes_the_whole_text(spark):
    good = "some words that come back " * 30
    rows = [(1, good + "▁ " + good), (2, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in (al.Sizes(), al.Sizes(long=50, range=20, fan=2)):
        found = sorted(map(tuple, al.alignment_report(docs, PAIR, sizes).collect()))
        assert found == plain_report(rows)
        assert found[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_fragments_compose_in_any_order():
    known, dealt, open_ends = al.vocabularies(PAIR), random.Random(3), 0
    words = ["the", "unbelievable", "漢字", "naïve", "x1y2", "...", "Жук"]
    for _ in range(60):
        text = " " + " ".join(dealt.choices(words, k=30)) + "".join(dealt.choices(words, k=10))
        a, b = known.encode(text)
        groups, _ = walked(*[[(n, table[n]) for n in ids.tolist()] for ids, table in ((a, known.a_bytes), (b, known.b_bytes))])
        width = dealt.randint(1, 12)
        parts = al.fragments_of(0, (a, b), known, width)
        open_ends += sum(p.suffix is None or bool(p.suffix.a) for p in parts)

        def composed(lo, hi):
            if hi - lo == 1:
                return parts[lo]
            middle = dealt.randint(lo + 1, hi - 1)
            return composed(lo, middle) * composed(middle, hi)

        def segments_in_order(x):
            assert x.suffix is not None and not x.suffix.a and not x.suffix.b
            return [x.prefix, *x.closed]

        for whole in (composed(0, len(parts)), composed(0, len(parts))):
            found = []
            for run in segments_in_order(whole):
                tokens = [[(n, table[n]) for n in ids] for ids, table in ((run.a, known.a_bytes), (run.b, known.b_bytes))]
                found += walked(*tokens)[0]
            assert found == groups
    assert open_ends > 200


def test_texts_of_groups():
    known = al.vocabularies(PAIR)
    a, b = known.encode(" unbelievable naïve text, 漢字")
    found = al.align(np.cumsum(known.a_size[a]), np.cumsum(known.b_size[b]))
    tokens = [[(n, table[n]) for n in ids.tolist()] for ids, table in ((a, known.a_bytes), (b, known.b_bytes))]
    assert "".join(al.marked_ids(a, b, found)[0])[:-1] == text_of(walked(*tokens)[0])
