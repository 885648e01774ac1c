"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from guichet.operators import aggregate as A
from guichet.operators import profile, projects
from guichet.plans.star import declarations, line_order

SF = "/root/testdata/sf0.001"
QUERIES = spark_entry.queries()


def plan_of(df, capsys, mode=None):
    capsys.readouterr()
    df.explain(mode) if mode else df.explain()
    return capsys.readouterr().out


LAZY = [
    "top_countries_by_amount", "amount_by_region", "amount_by_month", "indicators", "chart_table",
    "chart_top_ten_countries", "lines_without_repeats", "earliest_line_per_project", "project_rollup",
    "french_decimals", "normalized_texts", "model_dataset", "most_frequent_values", "dropdown_domains",
    "random_split", "splits_put_together", "stratified_split", "decile_split", "ordinal_codes",
    "target_encoding_out_of_fold", "feature_table", "project_sums_on_every_line", "explore_dataset",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_no_cross_joins(spark, name, capsys):
    plan = plan_of(QUERIES[name](spark, SF), capsys)
    for unwanted in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


def test_only_needed_tables_and_columns_are_read(spark, capsys):
    plan = plan_of(QUERIES["top_countries_by_amount"](spark, SF), capsys)
    assert "part.parquet" not in plan and "region.parquet" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan
    assert "TakeOrderedAndProject" in plan


def test_sums_are_partial_before_the_shuffle(spark, capsys):
    d = declarations(spark, SF, "financing", "committed")
    plan = plan_of(A.sum_by(d, "financing", "committed"), capsys)
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_sum")
    assert plan.count("Exchange hashpartitioning") == 1


def test_rollup_reduces_before_each_of_two_shuffles(spark, capsys):
    d = declarations(spark, SF, "project", "line", "part", "supplier", "signed", "committed")
    plan = plan_of(projects.project_rollup(d, "project", "signed", "committed", line_order()), capsys)
    assert plan.count("Exchange hashpartitioning") == 2
    first, second = [m.start() for m in re.finditer("Exchange hashpartitioning", plan)]
    assert "partial_min_by" in plan[first:second]
    assert re.search(r"WindowGroupLimit.*Partial", plan[second:])


def test_short_lists_are_cut_per_task(spark, capsys):
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    plan = plan_of(profile.dropdown_domains(customers, ["c_name"]), capsys)
    assert re.search(r"WindowGroupLimit.*200, Partial", plan)


def test_first_seen_values_use_a_hash_aggregate(spark, capsys):
    d = declarations(spark, SF, "sector", "product", "project")
    plan = plan_of(profile.column_values(d, ["sector", "product"], first=F.min("project")), capsys)
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_filters_of_the_dashboard_reach_the_scan(spark, tmp_path, capsys):
    from guichet.plans.dashboard import DashboardColumns, dashboard_cube

    path = str(tmp_path / "d")
    declarations(spark, SF, "year", "country", "region", "sector", "committed", "agency").write.parquet(path)
    names = DashboardColumns("committed", "year", "country", "region", "sector")
    plan = plan_of(dashboard_cube(spark.read.parquet(path), (1996, 2000), ["ASIA"], None, names), capsys, "formatted")
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "GreaterThanOrEqual(year,1996)" in pushed and "LessThanOrEqual(year,2000)" in pushed
    assert "EqualTo(region,ASIA)" in pushed
    assert "agency" not in re.search(r"ReadSchema: (.*)", plan).group(1)
