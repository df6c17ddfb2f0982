from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

import corpus_pipeline

from barloom.llm import bpe, common, toxicity
from brute import line_dedup, mix, near_components, sha

SF = "/root/testdata/sf0.001"


def brute_run(spark):
    """The stages on plain rows; the lexicon, whose learning is tested on its own, is learned alike."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn_lexicon(docs, labels, ~toxicity.held_out())
    curve, rows = lexicon.curve, []
    for r in docs.collect():
        folded = toxicity.fold(r.text)
        total = sum(
            w for at in range(len(folded)) for w in [max((w for t, w in lexicon.weights if folded.startswith(t, at)), default=0)]
        )
        x = np.log1p([total, 100 * total / max(1, len(folded.split()))])
        if 1 / (1 + np.exp(-(curve[0] + curve[1] * x[0] + curve[2] * x[1]))) < 0.5:
            rows.append((r.doc_id, r.source, r.text))
    assert not lexicon.exceptions
    left = {d: t for d, _, _, t in line_dedup([(d, t) for d, _, t in rows])}
    found = near_components(list(left.items()), 5, 80)
    rows = [(d, s, left[d]) for d, s, _ in rows if found[d][1] == d]
    out, codec = [], bpe.encoder(public_tokenizers.path(corpus_pipeline.RANKS), public_tokenizers.PATTERN)
    texts = {d: t for d, _, t in rows}
    for d, size, total, goal, taken in mix(rows):
        epochs = int(goal + 0.5) // total if total else 0
        part = taken - epochs * size
        copies = epochs + (part > 0 and 2 * part >= size)
        ids = codec.encode_ordinary(texts[d])
        out += [(d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[d]))] * copies
    return out


def test_matches_brute_force(spark):
    found = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert Counter(found) == Counter(brute_run(spark))


def test_stages_keep_the_columns_of_documents(spark, odd_docs, no_docs):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_docs.select(names), no_docs.select(names)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.stored(stage(spark, docs, SF))
            assert docs.columns == names
            assert dict(docs.dtypes) == dict(odd_docs.select(names).dtypes)
            assert docs.where(F.col("n_chars") != F.length(F.coalesce("text", F.lit("")))).count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding",
    ]


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op4_mixing", "op6_line_dedup", "op8_jaccard_join", "op9_url_filter"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from barloom.llm.queries import ORACLE, QUERIES

    with duckdb.connect() as con:
        for table in ("documents", "pages"):
            con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
        sql = con.sql(ORACLE[name])
        want, columns = sql.fetchall(), sql.columns
    found = QUERIES[name](spark, SF).select(*columns).collect()
    assert Counter(map(tuple, found)) == Counter(want)
