"""Every registered query with SQL against DuckDB on the smallest tables, and the driver's contract."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tideline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    want = [tuple(map(plain, r)) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert [tuple(map(str, r)) for r in sorted(got, key=key)] == [tuple(map(str, r)) for r in sorted(want, key=key)]


@pytest.mark.parametrize("name", ["change_segments", "run_lengths", "gap_fill", "key_hold", "budget_prefix", "section_offsets"])
def test_chains_of_running_values_scan_their_rows_twice_at_most(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert 1 <= plan.count("Scan parquet") <= 2


@pytest.mark.parametrize("name", ["change_segments", "gap_fill", "key_hold", "budget_prefix", "segment_bounds"])
def test_chains_of_running_values_are_one_step(spark, name):
    """Before any reuse of stages: a scan for the rows and one for the block totals, and few windows."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    steps = 2 if name == "segment_bounds" else 1  # ranks first
    assert plan.count("Scan parquet") <= 2 ** steps and plan.count("Window ") <= 12 * steps


def test_contract(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(catalog.QUERIES) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)
