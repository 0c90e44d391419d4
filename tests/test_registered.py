"""Every registered query against its SQL twin on the smallest given tables."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.8f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_twin(spark, sf_dir, database, name):
    df = contract.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = database.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert canonical(expected) == canonical(tuple(r) for r in df.select(*columns).collect())


def test_entry_has_rows(spark, sf_dir):
    assert contract.entry(spark).count() == 40
