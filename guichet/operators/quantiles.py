"""Exact quantiles of large columns.

Spark's exact ``percentile`` keeps every distinct value of the column in one
buffer. Here an approximate pass brackets each wanted rank. Brackets that hold many rows are
narrowed by approximate passes over these rows, all columns at once, until none holds more than
LISTED; a last pass counts what is below the brackets and lists only the values inside.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from guichet.functions.numbers import finite
from guichet.functions.text import quoted

ACCURACY = 100_000
# Rows of a bracket that may be listed, and so ordered in one task.
LISTED = 100_000
_RANKS = "column string, prob double, lower long, upper long, part double"


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _cell(value: Column, brackets: list[tuple[float, float]]) -> Column:
    """Values inside a bracket stand for themselves, others for the gap they are in."""
    cell, below = None, -math.inf
    for low, high in brackets:
        gap = F.struct(F.lit(below).alias("value"), F.lit(True).alias("gap"))
        inside = F.struct(value.alias("value"), F.lit(False).alias("gap"))
        cell = F.when(value < low, gap) if cell is None else cell.when(value < low, gap)
        cell = cell.when(value <= high, inside)
        below = high
    return cell.otherwise(F.struct(F.lit(below).alias("value"), F.lit(True).alias("gap")))


def quantile_table(df: DataFrame, names: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, prob, value) with linear interpolation; all-null columns have no rows."""
    long = (
        df.select(*[finite(quoted(c)).alias(c) for c in names])
        .unpivot([], [quoted(c) for c in names], "column", "value")
        .where(F.col("value").isNotNull())
    )
    margin = 2.0 / ACCURACY
    while True:
        brackets, wanted, n = _bracketed(long, list(probs), margin)
        # An approximation is off by 1 / ACCURACY of the rows at most on either side.
        crowded = n * (2 * margin + 2.0 / ACCURACY) > LISTED
        narrow = _narrowed(long, brackets, wanted, margin) if crowded else brackets
        found = None if narrow is None else _listed(long, narrow, wanted)
        if found is not None:
            return found
        margin *= 10  # an approximate bound was off: widen the brackets


def _bracketed(long, probs, margin):
    """(brackets per column, wanted ranks, rows of the longest column): a bracket around each rank
    by an approximate pass."""
    ends = [min(max(p + side, 0.0), 1.0) for p in probs for side in (-margin, margin)]
    # One row per column.
    bounds = {
        row["column"]: row
        for row in long.groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("value", ends, ACCURACY).alias("ends"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .collect()
    }
    brackets, wanted = {}, []
    for name, row in bounds.items():
        pairs = list(zip(row["ends"][::2], row["ends"][1::2]))
        pairs = [
            (row["low"] if p - margin <= 0 else a, row["high"] if p + margin >= 1 else b)
            for p, (a, b) in zip(probs, pairs)
        ]
        brackets[name] = _merged(pairs)
        for p in probs:
            place = (row["n"] - 1) * p
            wanted.append((name, p, math.floor(place), math.ceil(place), place - math.floor(place)))
    return brackets, wanted, max((row["n"] for row in bounds.values()), default=0)


def _slot(brackets) -> Column:
    """The bracket a value is in as an odd number, the gap before it as the even one below."""
    slot = F.lit(None).cast("int")
    for name, pairs in brackets.items():
        own = F.lit(2 * len(pairs))
        for i, (low, high) in reversed(list(enumerate(pairs))):
            own = F.when(F.col("value") < low, 2 * i).when(F.col("value") <= high, 2 * i + 1).otherwise(own)
        slot = F.when(F.col("column") == name, own).otherwise(slot)
    return slot


def _narrowed(long, brackets, wanted, margin):
    """Brackets that hold at most LISTED rows or one value each; None if a rank is in none of them."""
    brackets = dict(brackets)
    while True:
        slotted = long.withColumn("slot", _slot(brackets))
        # As many rows as brackets and gaps.
        counts = {(r["column"], r["slot"]): r["n"] for r in slotted.groupBy("column", "slot").agg(F.count(F.lit(1)).alias("n")).collect()}
        asked: dict[tuple[str, int], list[float]] = {}
        for name, pairs in brackets.items():
            below = 0
            ranks = sorted({rank for column, _, lower, upper, _ in wanted if column == name for rank in (lower, upper)})
            for slot in range(2 * len(pairs) + 1):
                n = counts.get((name, slot), 0)
                inside = [rank - below for rank in ranks if below <= rank < below + n]
                if inside and slot % 2 == 0:
                    return None
                low, high = pairs[slot // 2] if slot % 2 else (0.0, 0.0)
                if slot % 2 and n > LISTED and low < high:
                    asked[name, slot] = [(rank / (n - 1)) for rank in inside]
                below += n
        if not asked:
            return brackets
        estimates = [
            F.percentile_approx(
                F.when((F.col("column") == name) & (F.col("slot") == slot), F.col("value")),
                [min(max(p + side, 0.0), 1.0) for p in places for side in (-margin, margin)], ACCURACY,
            ).alias(f"e{i}")
            for i, ((name, slot), places) in enumerate(asked.items())
        ]
        found = slotted.agg(*estimates).first()
        narrower = {name: [] for name in brackets}
        for name, pairs in brackets.items():
            for i, pair in enumerate(pairs):
                key = (name, 2 * i + 1)
                if key not in asked:
                    narrower[name].append(pair)
                    continue
                ends = found[list(asked).index(key)]
                for p, low, high in zip(asked[key], ends[::2], ends[1::2]):
                    narrower[name].append((pair[0] if p - margin <= 0 else low, pair[1] if p + margin >= 1 else high))
            narrower[name] = _merged(narrower[name])
        if narrower == brackets:
            return brackets  # as narrow as the approximation can tell
        brackets = narrower


def _listed(long, brackets, wanted) -> DataFrame | None:
    cell = F.lit(None).cast("struct<value:double,gap:boolean>")
    for name, pairs in brackets.items():
        cell = F.when(F.col("column") == name, _cell(F.col("value"), pairs)).otherwise(cell)
    # Per column: the values inside the brackets, at most LISTED each, and the gaps.
    upto = Window.partitionBy("column").orderBy("cell.value", "cell.gap")
    cells = (
        long.groupBy("column", cell.alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("column", "cell.value", "cell.gap", F.sum("n").over(upto).alias("upto"))
    )
    ranks = long.sparkSession.createDataFrame(wanted, _RANKS)
    # As many rows as columns times probabilities on one side, and in the result.
    hits = (
        cells.join(F.broadcast(ranks), "column")
        .groupBy("column", "prob", "part")
        .agg(
            *[
                F.min(F.when(F.col("upto") > F.col(end), F.struct("upto", "value", "gap"))).alias(end)
                for end in ("lower", "upper")
            ]
        )
        .collect()
    )
    if any(hit[end]["gap"] for hit in hits for end in ("lower", "upper")):
        return None
    found = []
    for hit in hits:
        low, high = hit["lower"]["value"], hit["upper"]["value"]
        found.append((hit["column"], hit["prob"], low + (high - low) * hit["part"]))
    return long.sparkSession.createDataFrame(found, "column string, prob double, value double")


def median(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value): the exact median of each column."""
    return quantile_table(df, names, [0.5]).select("column", "value")


def decile_edges(df: DataFrame, name: str, q: int = 10) -> list[float]:
    """The distinct quantile edges of a column, at most q + 1 of them."""
    table = quantile_table(df, [name], [i / q for i in range(q + 1)])
    return sorted({row["value"] for row in table.collect()})


def decile_of(value: Column, edges: Sequence[float]) -> Column:
    """0-based bin of a value: right-closed, the lowest value included."""
    c = finite(value)
    bin_ = F.lit(max(len(edges) - 2, 0))
    for i, edge in reversed(list(enumerate(edges[1:-1]))):
        bin_ = F.when(c <= edge, i).otherwise(bin_)
    return F.when(c.isNotNull(), bin_).cast("int")


def decile_bins(df: DataFrame, name: str, q: int = 10, out: str = "bin") -> DataFrame:
    """Quantile bin of each row."""
    return df.withColumn(out, decile_of(quoted(name), decile_edges(df, name, q)))
