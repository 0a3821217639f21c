"""The queries with a DuckDB form against it."""

from collections import Counter

import duckdb
import pytest

from tideline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_more, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_more}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_more)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert rel.columns == df.columns
    assert Counter(map(tuple, df.collect())) == Counter(rel.fetchall())
