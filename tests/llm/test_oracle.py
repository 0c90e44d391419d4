import duckdb
import pytest
from helpers import by_id

from trialquota.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_queries()))
def test_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    result = con.execute(queries.oracle_queries()[name])
    names = [d[0] for d in result.description]
    df = queries.registered()[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert by_id(result.fetchall()) == by_id(df.select(*names).collect())
