"""Grouped and global aggregates.

Groups with a null key are left out and the sum of nothing is 0. All of these are
partial aggregates before the shuffle, so a key holding most rows sends one row
per task, not its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from guichet.functions.dates import period_label
from guichet.functions.numbers import exact_mean, exact_sum, finite, to_millions
from guichet.functions.text import quoted


def measure(name: str | None, how: str = "sum", scale: int | None = None) -> Column:
    """An aggregate by name: sum, mean, count or nunique."""
    if how == "count":
        return F.count(F.lit(1)) if name is None else F.count(quoted(name))
    if name is None:
        raise ValueError(f"{how} needs a column")
    c = quoted(name)
    if how == "sum":
        return exact_sum(c, scale)
    if how == "mean":
        return exact_mean(c, scale)
    if how == "nunique":
        return F.count_distinct(c)
    raise ValueError(f"unknown measure {how!r}: sum, mean, count or nunique")


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in which none of ``keys`` is null or NaN."""
    for key in keys:
        df = df.where(quoted(key).isNotNull())
        if isinstance(df.schema[key].dataType, (T.DoubleType, T.FloatType)):
            df = df.where(~F.isnan(quoted(key)))
    return df


def sum_by(df: DataFrame, key: str, name: str, scale: int | None = None) -> DataFrame:
    return keyed(df, [key]).groupBy(quoted(key)).agg(measure(name, "sum", scale).alias("value"))


def mean_by(df: DataFrame, key: str, name: str, scale: int | None = None) -> DataFrame:
    return keyed(df, [key]).groupBy(quoted(key)).agg(measure(name, "mean", scale).alias("value"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return keyed(df, [key]).groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("value"))


def top_n_by(df: DataFrame, key: str, name: str, n: int, scale: int | None = None) -> DataFrame:
    """The ``n`` largest group sums; equal sums go by key."""
    sums = sum_by(df, key, name, scale)
    return sums.orderBy(F.desc("value"), quoted(key)).limit(n)


def trend_by(df: DataFrame, key: str, name: str, scale: int | None = None) -> DataFrame:
    return sum_by(df, key, name, scale).orderBy(quoted(key))


def trend_by_period(
    df: DataFrame, date: str, period: str, name: str, scale: int | None = None
) -> DataFrame:
    """Sums per month or quarter that has rows, in calendar order."""
    labelled = df.select(
        period_label(quoted(date), period).alias("period"), quoted(name).alias("_amount")
    )
    return trend_by(labelled, "period", "_amount", scale)


def total(df: DataFrame, name: str, scale: int | None = None) -> DataFrame:
    return df.agg(measure(name, "sum", scale).alias("value"))


def mean_of(df: DataFrame, name: str, scale: int | None = None) -> DataFrame:
    return df.agg(measure(name, "mean", scale).alias("value"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value"))


def count_distinct(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count_distinct(quoted(name)).alias("value"))


def kpis(df: DataFrame, amount: str, country: str, scale: int | None = None) -> DataFrame:
    """Total in millions, rows, countries and mean amount, in one pass."""
    return df.agg(
        to_millions(measure(amount, "sum", scale)).alias("total_millions"),
        F.count(F.lit(1)).alias("projects"),
        F.count_distinct(quoted(country)).alias("countries"),
        measure(amount, "mean", scale).alias("mean_amount"),
    )


def share_by(df: DataFrame, key: str, name: str, n: int, scale: int | None = None) -> DataFrame:
    """The ``n`` largest groups with their part of what is shown."""
    shown = top_n_by(df, key, name, n, scale)
    # At most n rows reach this window.
    whole = F.sum("value").over(Window.partitionBy(F.lit(1)))
    return shown.withColumn(
        "share", F.when(whole != 0, F.col("value") / whole)
    )


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return keyed(df, [name]).select(quoted(name)).distinct().orderBy(quoted(name))


def dataset_stats(df: DataFrame, target: str, test: str, n_features: int) -> DataFrame:
    """Sizes and target means of a split table; ``test`` is a boolean column."""
    held = F.col(test)
    y = quoted(target)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows_after_dropna"),
        F.lit(n_features).alias("n_features"),
        F.count_if(~held).alias("n_train"),
        F.count_if(held).alias("n_test"),
        exact_mean(F.when(~held, y), 12).alias("target_mean_train"),
        exact_mean(F.when(held, y), 12).alias("target_mean_test"),
    )


def regression_metrics(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """RMSE, MAE and R2 in one aggregate, per group of ``by`` if given."""
    y, error = finite(quoted(label)), finite(quoted(label)) - finite(quoted(prediction))
    spread, squares = F.var_pop(y) * F.count(y), F.sum(error * error)
    return df.groupBy(*[quoted(c) for c in by]).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.when(spread > 0, 1 - squares / spread)
        .when(spread == 0, F.when(squares == 0, 1.0).otherwise(0.0))
        .alias("r2"),
        F.count(y).alias("n"),
    )


def cv_summary(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each score over the folds."""
    out = []
    for name in names:
        out += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    return scores.agg(*out)
