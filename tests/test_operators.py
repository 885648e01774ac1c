"""Columns, filters, aggregates, series, projects, profiles."""

import datetime as dt
import json
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from guichet.operators import aggregate as A
from guichet.operators import columns, filters, profile, projects, quantiles, series, settle
from guichet.operators.ranks import number_rows
from guichet.plans.chart import ChartSpec, chart_query, to_payload
from guichet.plans.dashboard import DashboardColumns, dashboard, dashboard_panels


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def sales(spark):
    data = [
        ("a", dt.datetime(2018, 1, 5), 2018, 10.0),
        ("a", dt.datetime(2019, 2, 5), 2019, 5.5),
        ("b", dt.datetime(2019, 2, 6), 2019, 15.5),
        ("c", None, None, 1.0),
        (None, dt.datetime(2020, 7, 1), 2020, 100.0),
        ("d", dt.datetime(2020, 8, 1), 2020, None),
    ]
    return spark.createDataFrame(data, "key string, day timestamp_ntz, year int, amount double")


# Columns -------------------------------------------------------------------------


def test_column_names(spark):
    df = spark.createDataFrame(
        [(1, 2, 3, 4, 5, 6)], [" a ", "X (K USD)", "USD y", "Code x", "Bi/Multi.1", "decode"]
    )
    df = columns.strip_headers(df)
    assert "a" in df.columns
    assert "USD y" in columns.drop_columns_containing(df, "(K USD)").columns
    assert "USD y" not in columns.drop_columns_containing(df, "USD").columns
    assert columns.drop_columns_matching(df, "code|Code").columns == ["a", "X (K USD)", "USD y", "Bi/Multi.1"]
    assert columns.drop_if_present(df, ["Bi/Multi", "a"]).columns[-2:] == ["Bi/Multi.1", "decode"]
    assert columns.keep_if_present(df, ["decode", "zz", "Bi/Multi.1"]).columns == ["decode", "Bi/Multi.1"]
    assert rows(columns.concat_columns(df, [F.col("a")], [F.lit(9)])) == [(1, 9)]


def test_sparse_columns_are_strictly_above_the_limit(spark):
    df = spark.range(20).select(
        F.when(F.col("id") < 2, 1).alias("at_90"),
        F.when(F.col("id") < 1, 1).alias("at_95"),
        F.when(F.col("id") < 1, 1).alias("kept_95"),
        F.when(F.col("id") < 1, F.lit(1.0)).otherwise(float("nan")).alias("nan_95"),
    )
    assert columns.prune_sparse_columns(df, 90, ["kept_95"]).columns == ["at_90", "kept_95"]
    assert columns.prune_sparse_columns(df.where("id < 0"), 90).columns == df.columns
    assert dict(rows(columns.missing_pct(df))) == {"at_90": 90.0, "at_95": 95.0, "kept_95": 95.0, "nan_95": 95.0}


def test_types_and_cardinality(spark):
    df = spark.createDataFrame([("x", "u", 1, 2.0, True), ("y", None, 2, 3.0, False)],
                               "a string, b string, c int, d double, e boolean")
    assert columns.columns_by_type(df, ["d"]) == (["a", "b"], ["c"])
    assert columns.split_by_cardinality(df, ["a", "b"], 2) == (["b"], ["a"])
    assert columns.split_by_cardinality(df, [], 2) == ([], [])


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("1", "x", None), ("2", "3", None)], "a string, b string, c string")
    out = columns.infer_numbers(df, ["a", "b", "c"])
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["double", "string", "string"]


# Filters -------------------------------------------------------------------------


def test_filters(sales):
    assert filters.filter_in(sales, "key", []).count() == 6
    assert filters.filter_in(sales, "key", None).count() == 6
    assert filters.filter_in(sales, "key", ["a", "b"]).count() == 3
    assert filters.filter_range(sales, "year", 2018, 2019).count() == 3
    assert filters.filter_eq(sales, "key", "b").count() == 1
    assert filters.filter_cmp(sales, "year", ">=", 2019).count() == 4
    assert filters.filter_positive(sales, "amount").count() == 5
    assert filters.drop_nulls_subset(sales, ["key", "amount"]).count() == 4
    assert filters.drop_nulls_any(sales).count() == 3
    with pytest.raises(ValueError):
        filters.filter_cmp(sales, "year", "~", 1)


def test_filters_reach_the_scan(spark, tmp_path, sales, capsys):
    path = str(tmp_path / "sales")
    sales.write.parquet(path)
    df = filters.filter_in(filters.filter_range(spark.read.parquet(path), "year", 2018, 2019), "key", ["a"])
    A.sum_by(df, "key", "amount").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(year,2018)" in plan and "EqualTo(key,a)" in plan
    assert "day" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_coerce_int_or_drop(spark):
    df = spark.createDataFrame([("2019",), ("x",), (None,), ("2020.0",)], "y string")
    assert rows(filters.coerce_int_or_drop(df, "y")) == [(2019,), (2020,)]


# Aggregates ----------------------------------------------------------------------


def test_groups_follow_null_rules(sales):
    assert dict(rows(A.sum_by(sales, "key", "amount"))) == {"a": 15.5, "b": 15.5, "c": 1.0, "d": 0.0}
    assert dict(rows(A.mean_by(sales, "key", "amount"))) == {"a": 7.75, "b": 15.5, "c": 1.0, "d": None}
    assert dict(rows(A.count_by(sales, "key"))) == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert rows(A.total(sales, "amount")) == [(132.0,)]
    assert rows(A.mean_of(sales, "amount")) == [(26.4,)]
    assert rows(A.count_rows(sales)) == [(6,)]
    assert rows(A.count_distinct(sales, "key")) == [(4,)]
    assert rows(A.distinct_values(sales, "key")) == [("a",), ("b",), ("c",), ("d",)]


def test_top_n_breaks_ties_by_key(sales):
    assert rows(A.top_n_by(sales, "key", "amount", 1)) == [("a", 15.5)]
    assert rows(A.trend_by(sales, "year", "amount")) == [(2018, 10.0), (2019, 21.0), (2020, 100.0)]
    assert rows(A.trend_by_period(sales, "day", "Q", "amount")) == [
        ("2018Q1", 10.0), ("2019Q1", 21.0), ("2020Q3", 100.0)
    ]


def test_shares_of_what_is_shown(sales):
    shown = rows(A.share_by(sales, "key", "amount", 2))
    assert shown == [("a", 15.5, 0.5), ("b", 15.5, 0.5)]


def test_kpis_in_one_pass(sales):
    assert rows(A.kpis(sales, "amount", "key")) == [(0.132, 6, 4, 26.4)]


def test_metrics(spark):
    y, p = [1.0, 2.0, 4.0], [1.5, 2.0, 3.0]
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    r = A.regression_metrics(df, "y", "p").first()
    sse = sum((a - b) ** 2 for a, b in zip(y, p))
    sst = sum((a - statistics.mean(y)) ** 2 for a in y)
    assert (r["rmse"], r["mae"], r["r2"], r["n"]) == pytest.approx((math.sqrt(sse / 3), 0.5, 1 - sse / sst, 3))
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert A.regression_metrics(flat, "y", "p").first()["r2"] == 1.0
    scores = spark.createDataFrame([(0.1,), (0.4,), (0.7,)], "r2 double")
    assert rows(A.cv_summary(scores, ["r2"]))[0] == pytest.approx((0.4, np.std([0.1, 0.4, 0.7])))


# Series --------------------------------------------------------------------------


def test_nulls_sort_last_both_ways(sales):
    up = [r["amount"] for r in series.sort_by(sales, "amount", "key").collect()]
    down = [r["amount"] for r in series.sort_by(sales, "amount", "key", descending=True).collect()]
    assert up == [1.0, 5.5, 10.0, 15.5, 100.0, None]
    assert down == [100.0, 15.5, 10.0, 5.5, 1.0, None]
    assert [r["key"] for r in series.head(sales, "amount", 2, "key").collect()] == [None, "b"]


def test_changes(spark):
    values = [(1, 0.0), (2, 0.0), (3, 5.0), (4, 10.0), (5, -5.0), (6, 0.0), (7, -1.0)]
    df = spark.createDataFrame(values, "y int, v double")
    got = [r["change"] for r in series.pct_change(df, "y", "v").orderBy("y").collect()]
    assert got == [0.0, 0.0, math.inf, 100.0, -150.0, -100.0, -math.inf]


def test_changes_and_numbers_of_long_series(spark, small_broadcasts):
    values = [(i, float(i * i + 1)) for i in range(50)]
    df = spark.createDataFrame(values, "y int, v double").repartition(5)
    got = [r["change"] for r in series.pct_change(df, "y", "v").orderBy("y").collect()]
    want = pd.Series([v for _, v in values]).pct_change().fillna(0) * 100
    assert got == pytest.approx(list(want))
    numbered = series.numbered(df, F.col("y"), F.col("v"), F.desc("v")).orderBy("ord").collect()
    assert [(r["ord"], r["label"]) for r in numbered] == [(i + 1, str(49 - i)) for i in range(50)]


def test_last_n_comes_before_the_change(spark):
    df = spark.createDataFrame([(y, float(y - 2000)) for y in range(2010, 2021)], "y int, v double")
    out = series.pct_change(series.last_n(df, "y", 5), "y", "v", bounded=True).orderBy("y").collect()
    assert [r["y"] for r in out] == [2016, 2017, 2018, 2019, 2020]
    assert out[0]["change"] == 0.0 and out[1]["change"] == pytest.approx(100 / 16)


def test_summaries(spark):
    df = spark.createDataFrame([(1, "x", 1234.5), (2, "y", 10.0), (3, "z", 1.0), (4, "w", 0.0)],
                               "ord int, label string, value double")
    s = series.summarize_series(df, "Titre", "K EUR").first()["summary"]
    assert s == (
        "**Titre**. En tête : **x** (1 234,50 K EUR). Suivi de y (10), z (1). "
        "Total affiché (4 éléments) : 1 245,50 K EUR."
    )
    one = series.summarize_series(df.where("ord = 1")).first()["summary"]
    assert one == "En tête : **x** (1 234,50). Total affiché (1 éléments) : 1 234,50."
    assert series.summarize_series(df.where("ord < 0")).first()["summary"] == "Aucune donnée à afficher."
    assert series.summarize_series(df.where("ord < 0"), "T").first()["summary"] == "T"
    total = spark.createDataFrame([(5.0,)], "value double")
    assert series.summarize_scalar(total, "value", "Total", "K EUR").first()["summary"] == "**Total** : 5 K EUR."
    assert series.summarize_table(df, "T").first()["summary"] == "**T** — 4 ligne(s), 3 colonne(s)."


# Charts --------------------------------------------------------------------------


def test_chart_errors(sales):
    with pytest.raises(ValueError, match="nope.*key"):
        chart_query(sales, ChartSpec(key="nope", measure="amount"))
    with pytest.raises(ValueError, match="unknown chart type"):
        chart_query(sales, ChartSpec(type="radar", key="key", measure="amount"))
    with pytest.raises(ValueError, match="unknown measure"):
        chart_query(sales, ChartSpec(key="key", measure="amount", how="mode"))


def test_long_payloads_come_in_rows(sales, small_broadcasts):
    line = ChartSpec(type="line", key="year", measure="amount", title="L", unit="u")
    got = [json.loads(r[0]) for r in to_payload(chart_query(sales, line), line).collect()]
    head = [r for r in got if "type" in r]
    assert head == [{"type": "line", "title": "L", "items": 3, "x_label": "", "y_label": "", "unit": "u"}]
    items = sorted((r["ord"], r["label"], r["value"]) for r in got if "type" not in r)
    assert items == [(1, "2018", 10.0), (2, "2019", 21.0), (3, "2020", 100.0)]

    table = ChartSpec(type="table", key="key", measure="amount")
    got = [json.loads(r[0]) for r in to_payload(chart_query(sales, table), table).collect()]
    assert [r for r in got if "type" in r] == [{"type": "table", "title": "", "items": 4, "columns": ["key", "sum_amount"]}]
    assert sorted((r["ord"], *r["row"]) for r in got if "type" not in r)[0] == (1, "a", "15.5")


def test_a_large_limit_is_no_bound(sales, small_broadcasts):
    spec = ChartSpec(type="line", key="year", measure="amount", limit=2)
    assert [r["label"] for r in chart_query(sales, spec).orderBy("ord").collect()] == ["2018", "2019"]


@pytest.mark.parametrize("scale", [None, 6])
def test_sums_lose_no_value(spark, scale):
    def total(*values):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        return A.total(df, "v", scale).first()[0], A.mean_of(df, "v", scale).first()[0]

    assert total(1e23, 1e23) == (2e23, 1e23)
    assert total(1.0, float("inf")) == (float("inf"), float("inf"))
    assert total(1.0, float("nan"), None, 2.0) == (3.0, 1.5)
    assert total(None) == (0.0, None)
    if scale is None:
        assert total(*[1e-7] * 10)[0] == pytest.approx(1e-6)


def test_bars_show_at_most_fifteen(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    out = chart_query(df, ChartSpec(key="k", measure="v", limit=40)).orderBy("ord").collect()
    assert [r["label"] for r in out] == [str(99 - i) for i in range(15)]
    line = chart_query(df, ChartSpec(type="line", key="k", measure="v"))
    assert line.count() == 100


def test_payloads(sales):
    spec = ChartSpec(key="key", measure="amount", title="T", x_label="x", y_label="y", unit="K EUR")
    assert to_payload(chart_query(sales, spec), spec).first()[0] == (
        '{"type":"bar","title":"T","labels":["a","b","c","d"],"values":[15.5,15.5,1.0,0.0],'
        '"x_label":"x","y_label":"y","unit":"K EUR"}'
    )
    scalar = ChartSpec(type="scalar", measure="amount", title="S")
    assert to_payload(chart_query(sales, scalar), scalar).first()[0] == (
        '{"type":"scalar","title":"S","value":132.0,"unit":""}'
    )
    table = ChartSpec(type="table", keys=["key"], measures=[("sum", "amount"), ("count", None)], limit=2)
    assert to_payload(chart_query(sales, table), table).first()[0] == (
        '{"type":"table","title":"","columns":["key","sum_amount","count"],"rows":[["a","15.5","2"],["b","15.5","1"]]}'
    )
    line = ChartSpec(type="line", date="day", period="M", measure="amount")
    assert '"labels":["2018-01","2019-02","2020-07","2020-08"]' in to_payload(chart_query(sales, line), line).first()[0]


def test_dashboard_equals_separate_aggregates(spark):
    data = [("a", "r1", "s1", 2018, 10.0), ("a", "r1", "s2", 2019, 5.0), ("b", "r2", "s1", 2019, None),
            (None, None, "s1", 2019, 7.0), ("c", "r2", None, 2030, 1.0)]
    df = spark.createDataFrame(data, "country string, region string, sector string, year int, paid double")
    names = DashboardColumns("paid", "year", "country", "region", "sector")
    panels = dashboard(df, (2018, 2020), [], None, names)
    kept = df.where("year <= 2020")
    assert rows(panels["kpis"]) == rows(A.kpis(kept, "paid", "country"))
    assert rows(panels["top_countries"]) == rows(A.top_n_by(kept, "country", "paid", 10))
    assert rows(panels["sectors"]) == rows(A.top_n_by(kept, "sector", "paid", 8))
    assert rows(panels["years"]) == rows(A.trend_by(kept, "year", "paid"))
    assert rows(panels["regions"]) == rows(A.sum_by(kept, "region", "paid").orderBy("region"))
    assert dashboard_panels(panels).count() == 4 + 2 + 2 + 2 + 2
    nothing = dashboard(df, (1900, 1901), names=names)
    assert rows(nothing["kpis"]) == [(0.0, 0, 0, None)]


# Projects ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lines(spark):
    day = lambda d: dt.datetime(2020, 1, d)
    data = [
        (0, "p1", day(5), 10.0, 1.0, "late"),
        (1, "p1", day(2), 20.0, 2.0, "early"),
        (2, "p1", day(2), 20.0, 9.0, "repeat"),
        (3, "p1", None, 5.0, None, "undated"),
        (4, "p2", None, 7.0, None, "only"),
        (5, None, day(9), 3.0, 3.0, "no key, late"),
        (6, None, day(1), 4.0, 4.0, "no key, early"),
        (7, "p3", day(3), None, None, "no amount"),
        (8, "p4", day(4), 1.0, 1.0, "same day 1"),
        (9, "p4", day(4), 2.0, 1.0, "same day 2"),
    ]
    return spark.createDataFrame(
        data, "row_ord long, key string, day timestamp_ntz, amount double, grant double, note string"
    )


def test_rollup_of_projects(lines):
    out = projects.project_rollup(lines, "key", "day", "amount", [F.col("row_ord")], ["amount", "grant"])
    assert out.columns == lines.columns
    got = {r["key"]: (r["note"], r["amount"], r["grant"]) for r in out.collect()}
    assert got == {
        "p1": ("early", 35.0, 3.0),
        "p2": ("only", 7.0, 0.0),
        "p3": ("no amount", 0.0, 0.0),
        "p4": ("same day 1", 3.0, 2.0),
        None: ("no key, early", None, None),
    }


def test_rollup_equals_its_steps_on_any_partitioning(lines):
    order = [F.col("row_ord")]
    steps = projects.dedup_exact(lines, ["day", "amount", "key"], order)
    steps = projects.broadcast_group_sum(steps, "key", ["amount", "grant"])
    steps = projects.keep_first(steps, "key", "day", order)
    want = sorted(rows(steps), key=repr)
    for n in (1, 3, 7):
        got = projects.project_rollup(lines.repartition(n), "key", "day", "amount", order, ["amount", "grant"])
        assert sorted(rows(got), key=repr) == want


def test_rollup_without_a_date(lines):
    out = projects.project_rollup(lines.drop("day"), "key", "day", "amount", [F.col("row_ord")])
    assert {r["key"]: (r["note"], r["amount"]) for r in out.collect()} == {
        "p1": ("late", 35.0), "p2": ("only", 7.0), "p3": ("no amount", 0.0), "p4": ("same day 1", 3.0),
        None: ("no key, late", None),
    }


def test_rollup_preserves_the_total(lines):
    out = projects.project_rollup(lines, "key", "day", "amount", [F.col("row_ord")])
    steps = projects.dedup_exact(lines, ["day", "amount", "key"], [F.col("row_ord")])
    total = A.total(steps.where("key is not null"), "amount").first()[0]
    assert A.total(out, "amount").first()[0] == total


def test_hot_and_null_keys(spark, small_broadcasts):
    """One key holds a third of the rows and null another third."""
    df = spark.range(3000).select(
        "id",
        F.when(F.col("id") < 1000, "hot").when(F.col("id") < 2000, F.concat(F.lit("k"), F.col("id") % 997)).alias("key"),
        F.lit(1.0).alias("v"),
    )
    out = projects.broadcast_group_sum(df, "key", ["v"])
    assert out.count() == 3000
    pdf = df.toPandas()
    pdf["want"] = pdf.groupby("key")["v"].transform("sum")
    got = out.toPandas().merge(pdf[["id", "want"]], on="id")
    pd.testing.assert_series_equal(got["v"], got["want"], check_names=False)


def test_no_hot_keys(spark, small_broadcasts):
    df = spark.range(5000).select("id", (F.col("id") % 2500).alias("key"))
    side = settle.settle(spark.range(2500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x")))
    out = settle.attach(df, side, ["key"])
    assert out.count() == 5000 and out.where("x <> key * 2 or x is null").count() == 0


def test_repeats_are_dropped_before_the_shuffle(lines, capsys):
    projects.dedup_exact(lines, ["key"], [F.col("row_ord")]).explain()
    plan = capsys.readouterr().out
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


# Ranks and quantiles -------------------------------------------------------------


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(6)
    out, n = number_rows(df, [F.col("x")])
    assert n == 1000 and out.where("x <> position").count() == 0 and out.count() == 1000
    empty, n = number_rows(df.where("x < 0"), [F.col("x")])
    assert n == 0 and empty.count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    n = 4000 + seed
    pdf = pd.DataFrame(
        {
            "heavy": np.exp(rng.normal(size=n) * 4),
            "few": rng.integers(2000, 2005, n).astype(float),
            "zeros": np.where(rng.random(n) < 0.6, 0.0, rng.random(n)),
        }
    )
    pdf.loc[rng.random(n) < 0.1, "heavy"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in quantiles.quantile_table(df, list(pdf), probs).collect()}
    for c in pdf:
        for p in probs:
            assert got[c, p] == pytest.approx(pdf[c].quantile(p), rel=1e-12), (c, p)


def test_quantiles_with_coarse_brackets(spark, monkeypatch):
    """A bracket that misses its rank is widened until it does not."""
    monkeypatch.setattr(quantiles, "ACCURACY", 5)
    values = np.random.default_rng(0).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(8)
    got = {r["prob"]: r["value"] for r in quantiles.quantile_table(df, ["x"], [0.1, 0.5, 0.77]).collect()}
    assert got == pytest.approx({p: np.quantile(values, p) for p in (0.1, 0.5, 0.77)})


@pytest.mark.parametrize("kind", ["spread", "heavy", "ties"])
def test_crowded_brackets_are_narrowed(spark, monkeypatch, kind):
    """No task orders more than LISTED values of a column and rank."""
    monkeypatch.setattr(quantiles, "ACCURACY", 40)
    monkeypatch.setattr(quantiles, "LISTED", 30)
    pick = np.random.default_rng(4)
    values = {
        "spread": pick.normal(size=3000), "heavy": 10.0 ** pick.uniform(-200, 200, 3000),
        "ties": np.concatenate([np.full(1500, 7.0), pick.integers(0, 20, 1500)]).astype(float),
    }[kind]
    listed = []

    def watched(long, brackets, wanted, f=quantiles._listed):
        pairs = [pair for own in brackets.values() for pair in own]
        listed.extend(len(np.unique(values[(values >= a) & (values <= b)])) for a, b in pairs)
        return f(long, brackets, wanted)

    monkeypatch.setattr(quantiles, "_listed", watched)
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "x double, y double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in quantiles.quantile_table(df, ["x", "y"], probs).collect()}
    for p in probs:
        assert got["x", p] == pytest.approx(np.quantile(values, p)) and got["y", p] == pytest.approx(np.quantile(-values, p))
    assert listed and max(listed) <= 30


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert rows(profile.median(df, ["x"])) == []


@pytest.mark.parametrize("values", [
    list(range(1, 101)),
    [0] * 60 + list(range(40)),
    [5] * 10,
    [1, 2, 2, 2, 2, 2, 2, 3],
])
def test_decile_bins_like_qcut(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    got = [r["bin"] for r in quantiles.decile_bins(df, "x").orderBy("i").collect()]
    if len(set(values)) == 1:
        assert set(got) == {0}
        return
    want = pd.qcut(pd.Series(values, dtype=float), 10, labels=False, duplicates="drop")
    assert got == list(want)


# Profiles ------------------------------------------------------------------------


def test_profile_lines(spark):
    long_label = "x" * 50
    data = [(i, "b" if i % 2 else "a", f"v{19 - i:02d}", long_label + str(i % 2), "l'eau", i * 1.0) for i in range(20)]
    data.append((20, None, None, None, None, None))
    df = spark.createDataFrame(data, "n int, few string, many string, long string, quote string, x double")
    out = profile.profile_columns(df, F.col("n")).orderBy("position").collect()
    cut = "x" * 39 + "…"
    assert [r["line"] for r in out] == [
        "- 'n' (int)",
        "- 'few' (texte) valeurs: 'a', 'b'",
        "- 'many' (texte, 20 modalités, ex: 'v19', 'v18', 'v17')",
        f"- 'long' (texte, 2 modalités, ex: '{cut}', '{cut}')",
        "- 'quote' (texte) valeurs: \"l'eau\"",
        "- 'x' (double)",
    ]
    assert [r["n_distinct"] for r in out] == [None, 2, 20, 2, 1, None]


def test_profile_of_an_empty_text_column(spark):
    df = spark.createDataFrame([(1, None)], "n int, t string")
    out = profile.profile_columns(df, F.col("n")).where("column = 't'").first()
    assert out["n_distinct"] == 0 and out["line"] == "- 't' (texte) valeurs: "


def test_domains_and_modes(spark):
    df = spark.createDataFrame([(f"v{i:03d}", "y" if i % 2 else "x") for i in range(300)], ["a", "b"])
    got = {r["column"]: r["values"] for r in profile.dropdown_domains(df, ["a", "b"]).collect()}
    assert got == {"a": [f"v{i:03d}" for i in range(200)], "b": ["x", "y"]}
    assert dict(rows(profile.most_frequent(df, ["a", "b"]))) == {"a": "v000", "b": "x"}


def test_domain_of_a_column_without_values(spark):
    df = spark.createDataFrame([("x", None), ("y", None)], "a string, b string")
    got = {r["column"]: r["values"] for r in profile.dropdown_domains(df, ["a", "b"]).collect()}
    assert got == {"a": ["x", "y"], "b": []}


def test_first_rows_settle_what_is_no_number(spark):
    """A pass over all rows would meet the error in the last of them."""
    late = F.when(F.col("id") < 90_000, F.lit("word")).otherwise(F.raise_error(F.lit("read")).cast("string"))
    df = spark.range(0, 100_000, 1, 8).select(late.alias("a"))
    assert columns.infer_numbers(df, ["a"]).schema["a"].dataType.simpleString() == "string"
    numbers = spark.range(0, 5000, 1, 2).select(F.when(F.col("id") < 4999, "1").otherwise("word").alias("a"))
    assert columns.infer_numbers(numbers, ["a"]).schema["a"].dataType.simpleString() == "string"


def test_rollup_takes_one_shuffle_but_for_hot_keys(spark, lines, monkeypatch):
    order = [F.col("row_ord")]
    want = sorted(rows(projects.project_rollup(lines, "key", "day", "amount", order, ["amount", "grant"])), key=repr)
    # A long table; no key but null is hot.
    monkeypatch.setattr(settle, "SERIES_ROWS", 0)
    monkeypatch.setattr(settle, "HOT_KEYS", 1)
    out = projects.project_rollup(lines, "key", "day", "amount", order, ["amount", "grant"])
    cold = out._jdf.queryExecution().executedPlan().toString()
    # One by key, two for the lines without a key.
    assert cold.count("Exchange hashpartitioning") == 3
    assert sorted(rows(out), key=repr) == want
    # Every key with two lines is hot.
    monkeypatch.setattr(settle, "HOT_KEYS", 5)
    mixed = projects.project_rollup(lines, "key", "day", "amount", order, ["amount", "grant"])
    assert sorted(rows(mixed), key=repr) == want


def test_distinct_values_of_a_table_are_counted_apart(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", None, None), (None, 4, 1.0)], "k string, p int, v double")
    spec = ChartSpec(type="table", keys=["k"], measures=[("sum", "v"), ("nunique", "p"), ("count", None), ("nunique", "v")])
    out = chart_query(df, spec)
    assert out.columns == ["k", "sum_v", "nunique_p", "count", "nunique_v"]
    assert rows(out) == [("a", 5.0, 1, 2, 2), ("b", 0.0, 0, 1, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # No aggregate holds sums and distinct values.
    assert not [line for line in plan.splitlines() if "sum(" in line and "count(distinct" in line]
    assert not [line for line in plan.splitlines() if "Expand" in line]
