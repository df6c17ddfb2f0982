from pyspark.sql import functions as F

from barloom.llm import lines
from brute import line_dedup, sha


def numbered(rows):
    """Rows without an id count as documents of their own below all others."""
    return [(-1000 - i if d is None else d, t) for i, (d, t) in enumerate(rows)]


def test_matches_brute_force(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    want = [(d if d > -1000 else None, n, k, sha(t)) for d, n, k, t in line_dedup(numbered(rows))]
    found = [tuple(r) for r in lines.line_digests(odd_docs).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in found) > 0
    assert lines.line_digests(no_docs).count() == 0


def test_result_does_not_depend_on_batches(odd_docs):
    want = sorted(map(str, lines.line_digests(odd_docs).collect()))
    for rule in (lines.LineRule(batches=1), lines.LineRule(batches=7, fan=3)):
        assert sorted(map(str, lines.line_digests(odd_docs, rule).collect())) == want


def test_rows_without_an_id_are_documents_of_their_own(spark):
    shared, other = "a line that several documents share", "another line that documents share"
    both = [(1, f"{shared}\nx"), (2, f"{shared}\ny"), (None, f"{shared}\nz")]
    found = {(r.doc_id, r.n_dropped) for r in lines.line_digests(spark.createDataFrame(both, "doc_id long, text string")).collect()}
    assert found == {(1, 1), (2, 0), (None, 1)}
    rows = [(None, f"{k}\n{other}") for k in "abcd"]
    drops = sorted(r.n_dropped for r in lines.line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert drops == [0, 1, 1, 1]
    # Equal texts without an id are one document.
    same = [(None, other)] * 5 + [(7, f"{other}\nx")]
    assert {r.n_dropped for r in lines.line_digests(spark.createDataFrame(same, "doc_id long, text string")).collect()} == {0}


def test_the_sql_agrees_on_rows_without_an_id(spark):
    import duckdb

    from barloom.llm.sql import SQL

    shared = "a line that several documents share"
    rows = [(5, shared), (None, f"{shared}\nx"), (None, f"{shared}\ny"), (None, "alone"), (6, f" {shared.upper()}\nz")]
    connection = duckdb.connect()
    connection.execute("create table documents (doc_id bigint, text varchar)")
    connection.executemany("insert into documents values (?, ?)", rows)
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = connection.sql(f"select {', '.join(names)} from ({SQL['op6_line_dedup']})").fetchall()
    found = [tuple(r) for r in lines.line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_other_columns_pass(odd_docs):
    kept = lines.dedup_lines(odd_docs)
    assert set(kept.columns) >= set(odd_docs.columns) | {"n_dropped"}
    assert kept.where(F.col("size") == 1).count() == odd_docs.count()


def test_a_line_lies_in_one_run_and_levels_stay_short(spark):
    store = lines.LineRuns(spark, fan=2)
    for n in range(5):
        keys = spark.range(n * 5, n * 5 + 10).select(
            F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).alias("docs"), F.col("id").alias("owner")
        )
        fresh = store.against(keys)
        assert fresh.where("fresh").count() == (10 if n == 0 else 5)
        store.add(lines.sorted_run(fresh.where("fresh").drop("fresh")))
    held = store.rows()
    assert held.count() == held.select("h1").distinct().count() == 30
    assert [len(level) for level in store.levels] == [1, 0, 1]
