"""Ordered results: period changes, the last periods, and a sentence about them.

A series is an aggregate with one row per year, month, quarter or category. It is
ordered in one task only if its counted length allows, and with distributed row
numbers otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from guichet import vocabulary as V
from guichet.functions.numbers import format_number_fr
from guichet.functions.text import quoted
from guichet.operators.ranks import number_rows
from guichet.operators.settle import is_short, settle


def _in_order(*order: Column):
    return Window.partitionBy(F.lit(1)).orderBy(*order)


def sort_by(df: DataFrame, name: str, *ties: str, descending: bool = False) -> DataFrame:
    """Rows in the order of a column, nulls last either way, then of ``ties``."""
    c = quoted(name)
    first = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return df.orderBy(first, *[quoted(t) for t in ties])


def head(df: DataFrame, name: str, n: int, *ties: str, descending: bool = True) -> DataFrame:
    """The first ``n`` rows in that order; each task keeps only its own ``n``."""
    return sort_by(df, name, *ties, descending=descending).limit(n)


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` last rows, in ascending order."""
    return df.orderBy(F.desc_nulls_first(quoted(order))).limit(n).orderBy(quoted(order))


def pct_change(
    df: DataFrame, order: str, value: str, name: str = "change", bounded: bool = False
) -> DataFrame:
    """Change against the row before in percent; the first row and 0/0 give 0.

    ``bounded`` says that the series is known to be short, after ``last_n`` for one.
    """
    if not bounded:
        df = settle(df)
    if bounded or is_short(df):
        pairs = df.withColumn("_before", F.lag(quoted(value)).over(_in_order(quoted(order))))
    else:
        rows, _ = number_rows(df, [quoted(order)], "_place")
        shifted = rows.select((F.col("_place") + 1).alias("_place"), quoted(value).alias("_before"))
        pairs = rows.join(shifted, "_place", "left").drop("_place")
    before, now = F.col("_before"), quoted(value)
    infinite = F.lit(float("inf"))
    change = (
        F.when(before.isNull() | now.isNull(), 0.0)
        .when((before == 0) & (now == 0), 0.0)
        .when((before == 0) & (now > 0), infinite)
        .when(before == 0, -infinite)
        .otherwise((now / F.nullif(before, F.lit(0.0)) - 1) * 100)
    )
    return pairs.withColumn(name, change).drop("_before")


def numbered(
    df: DataFrame, label: Column, value: Column, *order: Column, bounded: bool = False
) -> DataFrame:
    """A series as (ord, label, value), ``ord`` starting at 1."""
    if not bounded:
        df = settle(df)
    if bounded or is_short(df):
        place = F.row_number().over(_in_order(*order)).cast("long")
    else:
        df, _ = number_rows(df, order, "_place")
        place = F.col("_place") + 1
    return df.select(
        place.alias("ord"), label.cast("string").alias("label"), value.cast("double").alias("value")
    )


def _unit(unit: str) -> str:
    return f" {unit}".rstrip()


def summarize_series(series: DataFrame, title: str = "", unit: str = "") -> DataFrame:
    """One French sentence on an (ord, label, value) series, with its parts."""
    def at(position: int, name: str) -> Column:
        return F.max(F.when(F.col("ord") == position, F.col(name)))

    facts = series.agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
        *[at(i, name).alias(f"{name}_{i}") for i in (1, 2, 3) for name in ("label", "value")],
    )
    shown_unit = _unit(unit)

    def follower(i: int) -> Column:
        return F.concat(F.col(f"label_{i}"), F.lit(" ("), format_number_fr(F.col(f"value_{i}")), F.lit(")"))

    # Wording of the sentence.
    head = F.lit(f"**{title}**.") if title else F.lit(None).cast("string")
    leader = F.concat(
        F.lit("En tête : **"), F.col("label_1"), F.lit("** ("),
        format_number_fr(F.col("value_1")), F.lit(f"{shown_unit})."),
    )
    followers = F.when(
        F.col("items") > 1,
        F.concat(F.lit("Suivi de "), F.concat_ws(", ", follower(2), follower(3)), F.lit(".")),
    )
    whole = F.concat(
        F.lit("Total affiché ("), F.col("items").cast("string"), F.lit(" éléments) : "),
        format_number_fr(F.col("total")), F.lit(f"{shown_unit}."),
    )
    sentence = F.when(F.col("items") == 0, F.lit(title or V.EMPTY_SUMMARY)).otherwise(
        F.concat_ws(" ", head, leader, followers, whole)
    )
    return facts.select(
        F.col("label_1").alias("leader"), F.col("items"), F.col("total"), sentence.alias("summary")
    )


def summarize_scalar(df: DataFrame, value: str, title: str = "", unit: str = "") -> DataFrame:
    text = F.concat(F.lit(f"**{title}** : "), format_number_fr(quoted(value)), F.lit(f"{_unit(unit)}."))
    return df.select(quoted(value).alias("value"), text.alias("summary"))


def summarize_table(df: DataFrame, title: str = "") -> DataFrame:
    head = f"**{title}** — " if title else ""
    width = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.concat(
            F.lit(head), F.col("rows").cast("string"), F.lit(f" ligne(s), {width} colonne(s).")
        ).alias("summary"),
    )
