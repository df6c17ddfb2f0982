import random
import zlib

from pyspark.sql import functions as F

from barloom.llm import toxicity


def lexicon(*terms, exceptions=()):
    return toxicity.Lexicon(tuple((t, 5.0) for t in terms), tuple(exceptions), (-4.0, 2.0, 1.0))


def scores(spark, texts, lex):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = rows.select("i", toxicity.toxicity(F.col("text"), lex).alias("score")).collect()
    return [r.score for r in sorted(found)]


def test_disguises_are_folded():
    for disguise in ("IDIOT", "1d10t", "іdіοt", "ｉｄｉｏｔ", "id\u00adiot", "id\u200biot"):
        assert toxicity.fold(disguise) == " idiot ", disguise
    assert toxicity.fold("") == "  "
    assert toxicity.fold("  A \t b\n") == " a b "


def test_terms_are_weighed_by_length_and_exceptions_cancel(spark):
    lex = lexicon(" idiot", " scum ", exceptions=(" scum of the earth ",))
    clean, plain, longer, spared, both, none = scores(
        spark, ["a b c", "an idiot", "an idiot " + "word " * 500, "scum of the earth", "scum of the earth and scum", None], lex
    )
    assert clean == none < 0.5 <= longer < plain
    assert spared == clean < both


def test_learned_terms_are_those_of_toxic_documents(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    dealt = random.Random(5)
    said = [(i, "vilest") for i in range(40)] + [(100 + i, "nicest") for i in range(60)] + [(200 + i, "vile") for i in range(12)]
    docs = [(i, " ".join([*dealt.choices(words, k=9), word, *dealt.choices(words, k=9)])) for i, word in said]
    docs += [(300 + i, docs[0][1].replace("vilest", "vilest once")) for i in range(20)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 100 or d >= 300)) for d, _ in docs], "doc_id long, toxic int")
    lex = toxicity.learn_lexicon(table, labels)
    # Neither the clean form nor the words of the copies are learned.
    assert [t for t, _ in lex.weights] == [" vilest "]
    found = scores(spark, ["the vilest", "the nicest", "vile manners"], lex)
    assert found[0] > 0.5 > max(found[1:])


def test_held_out_accuracy(sf_small):
    docs, labels = sf_small("documents", "sf0.1"), sf_small("labels", "sf0.1")
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (2, 0), (999, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    assert toxicity.toxicity_scores(odd_docs, labels.limit(0)).agg(F.max("score")).first()[0] < 0.5
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_words_of_any_length_can_be_terms():
    long = "x" * 300
    assert f" {long} " in toxicity.candidate_terms({long, "ab"}, (4,))
