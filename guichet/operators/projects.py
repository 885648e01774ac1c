"""From declaration lines to one row per project.

``order`` is a list of columns that puts lines in file order (or any total order);
the first line in that order survives.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from guichet.functions.numbers import exact_sum
from guichet.functions.text import quoted
from guichet.operators.settle import attach, hot_keys, is_short, stage


def dedup_exact(df: DataFrame, subset: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first line of each combination of ``subset``; nulls are equal.

    Spark keeps only the first row per group in every task before it shuffles.
    """
    same = Window.partitionBy(*[quoted(c) for c in subset]).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")


def keep_first(df: DataFrame, key: str, date: str, order: Sequence[Column]) -> DataFrame:
    """The earliest line per key, undated lines last; null keys form one group."""
    return dedup_exact(df, [key], [quoted(date).asc_nulls_last(), *order])


def broadcast_group_sum(
    df: DataFrame, key: str, names: Sequence[str], scale: int | None = None
) -> DataFrame:
    """Each row with the sums of its group in place of ``names``; null without a key.

    The sums are aggregated first and joined back, so the rows of a hot key are
    never gathered in one task.
    """
    rest = [c for c in df.columns if c not in names]
    keyed_rows = df.where(quoted(key).isNotNull())
    sums = stage(
        keyed_rows.groupBy(quoted(key)).agg(*[exact_sum(quoted(c), scale).alias(c) for c in names])
    )
    joined = attach(df.select(*[quoted(c) for c in rest]), sums, [key])
    return joined.select(*[quoted(c) for c in df.columns])


def project_rollup(
    df: DataFrame,
    key: str,
    date: str,
    amount: str,
    order: Sequence[Column],
    sums: Sequence[str] | None = None,
    scale: int | None = None,
) -> DataFrame:
    """One row per project: repeated lines removed, amounts added, earliest line kept.

    One shuffle by key, which holds and sorts the lines of a project together. The lines of hot keys
    and those without one are not gathered: they take two shuffles, both of rows already reduced per
    task, and so do all lines of a short table. Lines without a key become one row whose sums are
    null. Without a date column the first line is kept.
    """
    sums = [amount] if sums is None else list(sums)
    # The key goes first, so that lines sorted for repeats are sorted by project too.
    subset = [c for c in (key, date, amount) if c in df.columns]
    if is_short(df):
        return _rolled(dedup_exact(df, subset, order), key, date, order, sums, scale)
    keyed_rows = df.where(quoted(key).isNotNull())
    hot = hot_keys(keyed_rows, [key])
    others, spread = keyed_rows, [df.where(quoted(key).isNull())]
    if not hot.isEmpty():
        others = keyed_rows.join(F.broadcast(hot), [key], "left_anti")
        spread.append(keyed_rows.join(F.broadcast(hot), [key], "left_semi").select(*[quoted(c) for c in df.columns]))
    parts = [others.repartition(quoted(key)), reduce(DataFrame.unionByName, spread)]
    rolled = [_rolled(dedup_exact(part, subset, order), key, date, order, sums, scale) for part in parts]
    return reduce(DataFrame.unionByName, rolled).select(*[quoted(c) for c in df.columns])


def _rolled(lines, key, date, order, sums, scale) -> DataFrame:
    df = lines
    rest = [c for c in df.columns if c != key and c not in sums]
    dated = [quoted(date).isNull(), quoted(date)] if date in df.columns else []
    earliest = F.struct(*dated, *order)
    rolled = lines.groupBy(quoted(key).alias("_key")).agg(
        F.min_by(F.struct(*[quoted(c) for c in rest]), earliest).alias("_line"),
        *[exact_sum(quoted(c), scale).alias(c) for c in sums],
    )
    def shown(c: str) -> Column:
        if c == key:
            return F.col("_key").alias(c)
        if c in sums:
            return F.when(F.col("_key").isNotNull(), quoted(c)).alias(c)
        return F.col("_line").getField(c).alias(c)

    return rolled.select(*[shown(c) for c in df.columns])
