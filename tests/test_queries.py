"""Each query with SQL against DuckDB on the smallest tables; plans of the flagship search."""

import os

import duckdb
import pytest

from vellumspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toArrow()
    want = duck.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)
    a, b = (sorted(map(repr, zip(*[t.column(c).to_pylist() for c in names], strict=True))) for t in (got, want))
    assert a == b


def test_every_query_without_sql_has_rows(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0, name


def test_search_reads_stored_lists_and_cuts_before_the_shuffle(spark):
    plan = registry.queries()["search_idf_batch"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<term:string,df:bigint,doc_ids:array<bigint>>" in plan and "documents.parquet" not in plan
    assert "WindowGroupLimit" in plan


def test_building_reads_two_columns(spark):
    plan = registry.queries()["postings_capped"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "WindowGroupLimit" in plan
