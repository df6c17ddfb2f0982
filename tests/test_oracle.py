"""Every query against its plain SQL counterpart on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from barloom.checks.oracle import ORACLE
from barloom.checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
spec = importlib.util.spec_from_file_location("spark_entry", path)
driver = importlib.util.module_from_spec(spec)
spec.loader.exec_module(driver)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(key, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = driver.queries()[name](spark, SF_DIR)
    expected = con.sql(driver.oracle_sql()[name])
    assert table_of(df.columns, df.collect()) == table_of(expected.columns, expected.fetchall())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_only_model_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {
        "forest_predictions",
        "impurity_importance",
        "importance_table",
        "permutation_importance",
    }
