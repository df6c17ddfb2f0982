import pytest

from pyspark.sql import functions as F

from barloom.llm import mixing
from brute import mix


def same(found, want):
    assert len(found) == len(want)
    for a, b in zip(sorted(found, key=str), sorted(want, key=str)):
        assert a[:3] == b[:3] and a[4] == b[4]
        assert a[3] == pytest.approx(b[3])


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "source", "text").collect()]
    found = [tuple(r) for r in mixing.mix_report(odd_docs).collect()]
    same(found, mix(rows))
    assert mixing.mix_report(no_docs).count() == 0


def test_small_source_repeats_and_stops_at_three_times(spark):
    rows = [(i, "big", "w " * 30) for i in range(40)] + [(100 + i, "small", "w " * 7) for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix_report(table)
    same([tuple(r) for r in found.collect()], mix(rows))
    small = found.where("size = 7").agg(F.min("taken"), F.max("taken"), F.first("target")).first()
    assert tuple(small) == (21, 21, 63.0)
    assert found.agg(F.sum("taken")).first()[0] == 40 * 30 + 3 * 7


def test_buckets_change_nothing(odd_docs):
    want = sorted(map(str, mixing.mix_report(odd_docs).collect()))
    one = mixing.Mixture(bucket_digits=0)
    assert sorted(map(str, mixing.mix_report(odd_docs, one).collect())) == want


def test_documents_repeat_whole(odd_docs, no_docs):
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    texts = {r.text for r in odd_docs.select("text").collect()}
    assert {r.text for r in mixed.select("text").collect()} <= texts
    assert mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 6
    assert mixing.mix_documents(no_docs).count() == 0


def test_buckets_grow_in_number_with_the_rows():
    mixture = mixing.Mixture(bucket_digits=1, bucket_rows=10)
    assert [mixture.digits(n) for n in (0, 160, 161, 2_560, 2_561)] == [1, 1, 2, 2, 3]


def test_many_rows_without_an_id(spark):
    """They share a key and are taken by size, whatever the buckets; other ids lie around them."""
    rows = [(None if i % 3 else i, "ab"[i % 2], "w " * (1 + i % 7)) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for mixture in (mixing.Mixture(), mixing.Mixture(bucket_digits=0, bucket_rows=5)):
        same([tuple(r) for r in mixing.mix_report(table, mixture).collect()], mix(rows))


def test_rows_of_one_id_and_size_are_told_apart_by_their_text(spark):
    rows = [(7, "a", f"w{i} x") for i in range(30)] + [(8, "b", "w " * 400)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    runs = [sorted(map(str, mixing.mix_documents(table.repartition(n)).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]
