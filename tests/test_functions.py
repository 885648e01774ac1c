"""Column expressions, one trap per case."""

import datetime as dt
import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from guichet import vocabulary as V
from guichet.functions import dates, numbers, text


def apply(spark, values, kind, change):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["o"] for r in df.select("i", change(F.col("v")).alias("o")).orderBy("i").collect()]


def test_french_decimals(spark):
    raw = ["1 234,5", "12.5", "1\u00a0234,5", "abc", None, "nan", "-3,25", "1,2,3", "5d", "1e3", "", "inf"]
    want = [1234.5, 12.5, None, None, None, None, -3.25, None, None, 1000.0, None, math.inf]
    assert apply(spark, raw, "string", numbers.parse_fr_decimal) == want


def test_numbers_are_read_like_pandas(spark):
    raw = [
        "1e5", "1E+5", ".5", "5.", "+3", "--1", "1_000", "0x10", "1d", "1f", "1D", "inf", "-Infinity", "nan", "NaN",
        " 12 ", "1e", "e5", "1.2.3", "True", "", "-", "+", ".", "-0", "007", "1e-3", "12abc", "1 2", "infx",
    ]
    want = [None if math.isnan(v) else v for v in pd.to_numeric(pd.Series(raw), errors="coerce")]
    assert apply(spark, raw, "string", numbers.to_number) == want
    # Known difference: pandas has no value for numbers beyond the range of a double.
    assert apply(spark, ["1e400"], "string", numbers.to_number) == [math.inf]


def test_parse_amounts_by_unit(spark):
    df = spark.createDataFrame([("1,5", "2,5", "3,5")], ["A (K EUR)", "B (M USD)", "C"])
    assert numbers.parse_amounts(df).first().asDict() == {"A (K EUR)": 1.5, "B (M USD)": 2.5, "C": "3,5"}


def test_normalize_text(spark):
    raw = ["\u00a0 l’aide \u2003", "a\u00a0 b\t\nc\u202f", "nan", " nan ", None, "", "\x1cx\x1f\x1fy "]
    want = ["l'aide", "a b c", None, None, None, "", "x y"]
    assert apply(spark, raw, "string", text.normalize_text) == want


def test_missing_tokens(spark):
    raw = ["NA", "n/a", "null", "None", "", "#N/A", "Namibie", " NA"]
    assert apply(spark, raw, "string", text.missing_to_null) == [None] * 6 + ["Namibie", " NA"]


def test_dates_day_first_or_not(spark):
    raw = ["03/04/2020", "2020-12-31", "31/02/2020", "hier", None]
    day_first = apply(spark, raw, "string", dates.parse_date)
    assert day_first == [dt.datetime(2020, 4, 3), dt.datetime(2020, 12, 31), None, None, None]
    other = apply(spark, raw, "string", lambda c: dates.parse_date(c, V.DEFAULT_FORMATS))
    assert other[0] == dt.datetime(2020, 3, 4)


def test_period_labels(spark):
    days = [dt.datetime(2020, 4, 3), dt.datetime(2019, 12, 31), None]
    assert apply(spark, days, "timestamp_ntz", lambda c: dates.period_label(c, "M")) == ["2020-04", "2019-12", None]
    assert apply(spark, days, "timestamp_ntz", lambda c: dates.period_label(c, "Q")) == ["2020Q2", "2019Q4", None]
    with pytest.raises(ValueError):
        dates.period_label(F.col("v"), "W")


def test_date_parts_of_null(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 4, 3), 1, 2), (None, 1, 2)], "d timestamp_ntz, y int, k int")
    out = dates.date_parts(df, "d", day="day", year="year", month="month", drop=["y"])
    assert out.columns == ["k", "day", "year", "month"]
    assert [tuple(r)[2:] for r in out.collect()] == [(2020, 4), (None, None)]


def test_label_merges_are_simultaneous(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], ["x"])
    out = text.merge_labels(df, {"x": {"a": "b", "b": "c"}, "absent": {"a": "z"}})
    assert [r["x"] for r in out.collect()] == ["b", "c", "c", None]


@pytest.mark.parametrize("merges", [V.EXPLORE_LABELS, V.MODEL_LABELS])
def test_every_label_pair(spark, merges):
    for column, pairs in merges.items():
        df = spark.createDataFrame([(k,) for k in pairs], "x string").withColumnRenamed("x", column)
        got = [r[0] for r in text.merge_labels(df, merges).collect()]
        assert got == list(pairs.values())


def test_channel_groups_merge_in_opposite_directions():
    a, b = V.EXPLORE_LABELS[V.CHANNEL_GROUP], V.MODEL_LABELS[V.CHANNEL_GROUP]
    assert {v: k for k, v in a.items()} == b


def test_capitalize_is_not_initcap(spark):
    raw = ["fonds PROPRES du trésor", "ÉTAT", "", None]
    assert apply(spark, raw, "string", text.capitalize) == ["Fonds propres du trésor", "État", "", None]


def test_financing_class(spark):
    got = apply(spark, ["Dons", "Prêt", "Don", None], "string", text.financing_class)
    assert got == ["Don", "Prêt", "Autre", "Autre"]


def test_texts_are_normalised_like_python(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    raw = ["".join(["a", s, s, "b", s]) for s in spaces] + [s + "x" for s in spaces] + ["a\u200bb", "\ufeffa", " nan", "nan\n"]
    want = [re.sub(r"\s+", " ", v.replace("\u2019", "'").strip()) for v in raw]
    want = [None if v == "nan" else v for v in want]
    assert apply(spark, raw, "string", text.normalize_text) == want


def test_short_value(spark):
    raw = ["abc", "x" * 40, "x" * 41, "l'eau", "l'\"eau\"", "a\\b\nc"]
    got = apply(spark, raw, "string", text.short_value)
    assert got == [repr(v) if len(v) <= 40 else repr(v[:39] + "…") for v in raw]


def test_binarize(spark):
    raw = [None, "0", "2", "oui", "NaN", "-1", "0.5"]
    assert apply(spark, raw, "string", numbers.binarize) == [0, 0, 1, 0, 0, 0, 1]
    assert apply(spark, [float("nan"), 1.0, None], "double", numbers.binarize) == [0, 1, 0]


def test_grant_ratio(spark):
    rows = [(5.0, 10.0), (15.0, 10.0), (-1.0, 10.0), (None, 10.0), (1.0, 0.0), (1.0, -2.0), (1.0, None)]
    df = spark.createDataFrame(rows, "n double, d double")
    got = [r[0] for r in df.select(numbers.grant_ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [0.5, 1.0, 0.0, None, None, None, None]


def test_integers(spark):
    raw = ["2019", "2019.9", "x", None]
    assert apply(spark, raw, "string", numbers.coerce_int) == [2019, 2019, None, None]
    assert apply(spark, raw[:2], "string", numbers.require_int) == [2019, 2019]
    for bad in ("x", None):
        with pytest.raises(Exception, match="not an integer"):
            apply(spark, [bad], "string", numbers.require_int)


def test_marker_categories(spark):
    df = spark.createDataFrame([(1.0, 2), (None, None)], "Genre double, FTC int")
    out = numbers.marker_as_category(df, ["Genre", "FTC", "absent"]).collect()
    assert [tuple(r) for r in out] == [("1.0", "2"), ("nan", "nan")]


def test_bands_include_their_upper_bound(spark):
    bounds = [1.0, 1.792, 1.793, 2.852, 2.853, 5.017, 5.018]
    labels = V.BAND_LABELS
    want = [labels[0], labels[0], labels[1], labels[1], labels[2], labels[2], labels[3]]
    assert apply(spark, bounds, "double", numbers.amount_band) == want


def test_labels_and_formats(spark):
    assert apply(spark, [999.4, 1000.0, 1234567.0, 2.5, 3.5], "double", numbers.amount_label) == [
        f"{v:,.0f} K EUR" if v < 1000 else f"{v / 1000:,.1f} M EUR" for v in (999.4, 1000.0, 1234567.0, 2.5, 3.5)
    ]
    got = apply(spark, [1234567.891, 1234567.0, -1234.5, 0.0, None], "double", numbers.format_number_fr)
    assert got == ["1 234 567,89", "1 234 567", "-1 234,50", "0", None]


def test_logs_and_range(spark):
    assert apply(spark, [0.0, math.e - 1], "double", numbers.log_amount) == pytest.approx([0.0, 1.0])
    assert apply(spark, [1.0], "double", numbers.invert_log) == pytest.approx([math.e - 1])
    span = apply(spark, [2.0], "double", lambda c: numbers.prediction_range(c, 0.5))[0]
    assert (span["low"], span["high"]) == pytest.approx((math.expm1(1.5), math.expm1(2.5)))


def test_rounding_and_units(spark):
    assert apply(spark, [0.125, 0.375, 2.5], "double", lambda c: numbers.round_half_even(c, 2)) == [0.12, 0.38, 2.5]
    assert apply(spark, [1500.0], "double", numbers.to_millions) == [1.5]
    assert apply(spark, [1.5], "double", numbers.keur_to_eur) == [1500.0]


def test_sums_do_not_depend_on_partitions(spark):
    values = [(0.1 * i + 1e9 * (i % 3),) for i in range(1000)]
    df = spark.createDataFrame(values, "v double")
    got = {df.repartition(n).agg(numbers.exact_sum(F.col("v"))).first()[0] for n in (1, 3, 7, 16)}
    assert len(got) == 1


@pytest.mark.parametrize("low, high", [(-5, 5), (-20, 30), (-3, 12)])
def test_sums_are_exact_in_any_order(spark, low, high):
    pick = random.Random(low)
    values = [pick.choice((-1, 1)) * pick.random() * 10.0 ** pick.randint(low, high) for _ in range(3000)]
    values += [-v for v in values[:1500]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {df.repartition(n).agg(numbers.exact_sum(F.col("v"))).first()[0] for n in (1, 5)}
    assert len(got) == 1 and got.pop() == pytest.approx(math.fsum(values), rel=4e-16)


def test_sums_beyond_the_places(spark):
    def total(*values):
        return spark.createDataFrame([(v,) for v in values], "v double").agg(numbers.exact_sum(F.col("v"))).first()[0]

    inf = math.inf
    assert total(1e200, 1.0, -1e200) in (0.0, 1.0) and total(1e200, 1e200) == 2e200
    assert total(inf, 1.0) == inf and total(-inf, 1.0) == -inf and math.isnan(total(inf, -inf))
    assert total(5e-324, 5e-324) == 1e-323 and total(2.0**142, -(2.0**142), 2.0**-140) == 2.0**-140


def test_sums_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "v double")
    assert tuple(df.agg(numbers.exact_sum(F.col("v")), numbers.exact_mean(F.col("v"))).first()) == (1.5, 1.5)
    empty = df.where("v < 0")
    assert tuple(empty.agg(numbers.exact_sum(F.col("v")), numbers.exact_mean(F.col("v"))).first()) == (0.0, None)
