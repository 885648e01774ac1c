"""Choosing rows. Every predicate is a plain comparison, so it reaches the scan."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from guichet.functions.numbers import coerce_int
from guichet.functions.text import map_columns, quoted
from guichet.operators.aggregate import keyed

_COMPARE = {
    "==": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
}


def drop_nulls_subset(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return keyed(df, names)


def drop_nulls_any(df: DataFrame) -> DataFrame:
    return drop_nulls_subset(df, df.columns)


def filter_positive(df: DataFrame, name: str) -> DataFrame:
    return df.where(quoted(name) > 0)


def filter_range(df: DataFrame, name: str, low, high) -> DataFrame:
    return df.where(quoted(name).between(low, high))


def filter_in(df: DataFrame, name: str, values: Sequence | None = None) -> DataFrame:
    """Rows whose value is listed; no list at all means no filter."""
    return df.where(quoted(name).isin(list(values))) if values else df


def filter_eq(df: DataFrame, name: str, value) -> DataFrame:
    return df.where(quoted(name) == F.lit(value))


def filter_cmp(df: DataFrame, name: str, op: str, value) -> DataFrame:
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}, expected one of {list(_COMPARE)}")
    if op == "!=":
        # A null differs from every value.
        return df.where(~quoted(name).eqNullSafe(F.lit(value)))
    return df.where(_COMPARE[op](quoted(name), F.lit(value)))


def coerce_int_or_drop(df: DataFrame, name: str) -> DataFrame:
    """Cast to int; rows where that is not possible go."""
    return drop_nulls_subset(map_columns(df, [name], coerce_int), [name])
