"""Chart questions as data: a spec becomes an ordered result and a payload.

A spec names filters, a key or a period, a measure, an order and a chart type, the
whole vocabulary of questions. It is checked against the table before anything runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from guichet import vocabulary as V
from guichet.functions.dates import period_label
from guichet.functions.text import quoted
from guichet.operators.aggregate import keyed, measure
from guichet.operators.filters import filter_cmp, filter_in
from guichet.operators.series import last_n, numbered, pct_change
from guichet.operators import settle
from guichet.operators.ranks import number_rows

PAYLOAD_FIELDS = ["type", "title", "labels", "values", "x_label", "y_label", "unit", "value", "columns", "rows"]


@dataclass(frozen=True)
class ChartSpec:
    """One question.

    ``filters`` are (column, op, value) with op ``in`` or a comparison. Without key
    and period the answer is one number. ``order`` is ``value`` (largest first) or
    ``key`` (ascending). ``measures`` adds (how, column) columns to a table.
    """

    type: str = "bar"
    title: str = ""
    key: str | None = None
    date: str | None = None
    period: str | None = None
    measure: str | None = None
    how: str = "sum"
    filters: Sequence[tuple] = ()
    order: str = "value"
    limit: int | None = None
    last_n: int | None = None
    pct_change: bool = False
    keys: Sequence[str] = ()
    measures: Sequence[tuple] = field(default_factory=tuple)
    x_label: str = ""
    y_label: str = ""
    unit: str = ""
    scale: int | None = None


def _check(df: DataFrame, spec: ChartSpec) -> None:
    if spec.type not in V.CHART_TYPES:
        raise ValueError(f"unknown chart type {spec.type!r}, expected one of {V.CHART_TYPES}")
    if spec.order not in ("value", "key"):
        raise ValueError(f"order must be value or key, not {spec.order!r}")
    if (spec.period is None) != (spec.date is None):
        raise ValueError("period and date go together")
    named = [spec.key, spec.date, spec.measure, *spec.keys]
    named += [f[0] for f in spec.filters] + [m[1] for m in spec.measures]
    unknown = [c for c in named if c is not None and c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; the table has {df.columns}")


def _filtered(df: DataFrame, spec: ChartSpec) -> DataFrame:
    for name, op, value in spec.filters:
        if op != "in":
            df = filter_cmp(df, name, op, value)
        else:
            # An empty list selects nothing.
            df = filter_in(df, name, value) if value else df.where(F.lit(False))
    return df


def chart_query(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """(ord, label, value) for bar, line and pie; (value) for scalar; a table as it is.

    Bars and pies show at most 15 items: that limit is part of the chart.
    """
    _check(df, spec)
    df = _filtered(df, spec)
    if spec.type == "table":
        return _table(df, spec)
    if spec.type == "scalar":
        return df.agg(measure(spec.measure, spec.how, spec.scale).alias("value"))

    label = period_label(quoted(spec.date), spec.period) if spec.period else quoted(spec.key or "")
    amount = [] if spec.measure is None else [quoted(spec.measure).alias("_amount")]
    rows = keyed(df.select(label.alias("_label"), *amount), ["_label"])
    grouped = rows.groupBy("_label").agg(
        measure("_amount" if amount else None, spec.how, spec.scale).alias("_value")
    )
    by_label = spec.order == "key" or spec.period is not None or spec.type == "line"
    limit = spec.limit
    if spec.type in ("bar", "pie"):
        limit = min(limit or V.CHART_LIMIT, V.CHART_LIMIT)
    order = [F.col("_label")] if by_label else [F.desc_nulls_last("_value"), F.col("_label")]
    if spec.last_n:
        grouped = last_n(grouped, "_label", spec.last_n)
    if limit and limit <= settle.SERIES_ROWS:
        grouped = grouped.orderBy(*order).limit(limit)
    elif limit:
        places, _ = number_rows(grouped, order, "_nth")
        grouped = places.where(F.col("_nth") < limit).drop("_nth")
    bounded = _bounded(spec)
    value = F.col("_value")
    if spec.pct_change:
        grouped = pct_change(grouped, "_label", "_value", "_change", bounded)
        value = F.col("_change")
    return numbered(grouped, F.col("_label"), value, *order, bounded=bounded)


def _table(df: DataFrame, spec: ChartSpec) -> DataFrame:
    keys = list(spec.keys) or [c for c in [spec.key] if c]
    wanted = list(spec.measures) or [(spec.how, spec.measure)]
    names = [f"{how}_{c}" if c else how for how, c in wanted]
    by_key = [quoted(c) for c in keys]
    rows = keyed(df, keys)
    # Distinct values are grouped by themselves: beside the other measures, every value would carry theirs.
    parts = [[w for w in wanted if w[0] != "nunique"], *[[w] for w in dict.fromkeys(wanted) if w[0] == "nunique"]]
    grouped = [
        rows.groupBy(*by_key).agg(*[measure(c, how, spec.scale).alias(f"{how}_{c}" if c else how) for how, c in dict.fromkeys(part)])
        for part in parts if part
    ]
    out = reduce(lambda a, b: a.join(b, keys) if keys else a.crossJoin(b), grouped).select(*by_key, *[quoted(n) for n in names])
    out = out.orderBy(*(by_key if spec.order == "key" else [quoted(names[0]).desc_nulls_last(), *by_key]))
    return out.limit(spec.limit) if spec.limit else out


def _bounded(spec: ChartSpec) -> bool:
    """Whether the question bounds the length of its answer; others are counted."""
    limits = [n for n in (spec.limit, spec.last_n) if n]
    if spec.type in ("bar", "pie"):
        limits.append(V.CHART_LIMIT)
    # Calendar labels are few however many rows there are.
    return spec.period is not None or bool(limits and min(limits) <= settle.SERIES_ROWS)


def _rounded(c: Column) -> Column:
    return F.bround(c, 2)


def to_payload(result: DataFrame, spec: ChartSpec) -> DataFrame:
    """The JSON payload of a chart, in one row.

    A line or table that is too long for one cell comes in several: a head with the number
    of ``items``, and a row for each item with its place ``ord``.
    """
    text = {"title": F.lit(spec.title)}
    if spec.type != "scalar" and not _bounded(spec):
        result = settle.stage(result)
        if not settle.is_short(result):
            return _long_payload(result, spec)
    if spec.type in ("bar", "line", "pie"):
        items = F.array_sort(F.collect_list(F.struct("ord", "label", _rounded(F.col("value")).alias("value"))))
        fields = result.agg(items.alias("items"))
        text |= {
            "labels": F.col("items.label"),
            "values": F.col("items.value"),
            "x_label": F.lit(spec.x_label),
            "y_label": F.lit(spec.y_label),
            "unit": F.lit(spec.unit),
        }
    elif spec.type == "scalar":
        fields = result
        text |= {"value": _rounded(F.col("value").cast("double")), "unit": F.lit(spec.unit)}
    else:
        fields = _table_rows(result, spec)
        text |= {"columns": F.array(*[F.lit(c) for c in result.columns]), "rows": F.col("rows")}
    payload = F.struct(F.lit(spec.type).alias("type"), *[c.alias(n) for n, c in text.items()])
    return fields.select(F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def _long_payload(result: DataFrame, spec: ChartSpec) -> DataFrame:
    def as_json(**parts: Column) -> Column:
        row = F.struct(*[c.alias(n) for n, c in parts.items()])
        return F.to_json(row, {"ignoreNullFields": "false"}).alias("payload")

    head = {"type": F.lit(spec.type), "title": F.lit(spec.title), "items": F.count(F.lit(1))}
    if spec.type == "table":
        head["columns"] = F.array(*[F.lit(c) for c in result.columns])
        rows, _ = number_rows(result, _table_order(result, spec), "_place")
        items = rows.select(as_json(ord=F.col("_place") + 1, row=F.array(*_cells(result))))
    else:
        head |= {n: F.lit(getattr(spec, n)) for n in ("x_label", "y_label", "unit")}
        items = result.select(as_json(ord=F.col("ord"), label=F.col("label"), value=_rounded(F.col("value"))))
    return result.agg(as_json(**head)).unionByName(items)


def _table_order(result: DataFrame, spec: ChartSpec) -> list[Column]:
    by_key = [quoted(c) for c in (spec.keys or [spec.key]) if c]
    first_measure = result.columns[len(by_key)]
    return by_key if spec.order == "key" else [quoted(first_measure).desc_nulls_last(), *by_key]


def _cells(result: DataFrame) -> list[Column]:
    return [
        (_rounded(quoted(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else quoted(f.name))
        .cast("string")
        for f in result.schema.fields
    ]


def _table_rows(result: DataFrame, spec: ChartSpec) -> DataFrame:
    # A table that was counted or has a limit.
    nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*_table_order(result, spec)))
    listed = result.select(nth.alias("ord"), F.array(*_cells(result)).alias("cells"))
    items = F.array_sort(F.collect_list(F.struct("ord", "cells")))
    return listed.agg(items.alias("items")).select(F.col("items.cells").alias("rows"))
