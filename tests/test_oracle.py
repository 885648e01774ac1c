"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
from check import compare, connect

SF = "/root/testdata/sf0.001"
SQL = spark_entry.oracle_sql()
QUERIES = spark_entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = spark_entry.entry(spark).collect()
    assert len(rows) == 10
    assert [r["value"] for r in rows] == sorted((r["value"] for r in rows), reverse=True)


DISTRIBUTED = [
    "project_sums_on_every_line", "ordinal_codes", "ordinal_codes_with_unseen", "target_encoding",
    "target_encoding_out_of_fold", "random_split", "stratified_split", "decile_split",
    "contiguous_folds", "change_against_year_before", "chart_country_by_year", "dashboard_panels",
]


@pytest.mark.parametrize("name", DISTRIBUTED)
def test_query_equals_sql_without_broadcasts(spark, con, name, small_broadcasts):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None
