"""What the columns of a table hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from guichet import vocabulary as V
from guichet.functions.text import quoted, short_value, text_columns
from guichet.operators.quantiles import median
from guichet.operators.settle import stage

__all__ = ["column_values", "profile_columns", "dropdown_domains", "median", "most_frequent"]


def column_values(df: DataFrame, names: Sequence[str], **aggregates: Column) -> DataFrame:
    """(column, value, …): the distinct non-null values of several columns, as text.

    Counted per task before the shuffle, so frequent values stay cheap.
    """
    extra = [quoted(c) for c in df.columns if c not in names] if aggregates else []
    long = df.select(*extra, *[quoted(c).cast("string").alias(c) for c in names]).unpivot(
        extra, [quoted(c) for c in names], "column", "value"
    )
    present = long.where(F.col("value").isNotNull()).groupBy("column", "value")
    if not aggregates:
        return present.agg(F.count(F.lit(1)).alias("n"))
    return present.agg(*[a.alias(name) for name, a in aggregates.items()])


def _first_values(values: DataFrame, order: Sequence[Column], n: int, name: str) -> DataFrame:
    """(column, array of the first n values); at most n rows per task are shuffled."""
    nth = Window.partitionBy("column").orderBy(*order)
    return (
        values.withColumn("_nth", F.row_number().over(nth))
        .where(F.col("_nth") <= n)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("_nth", "value"))).alias("_items"))
        .select("column", F.col("_items.value").alias(name))
    )


def profile_columns(
    df: DataFrame, order: Column, enum_max: int = 12, val_maxlen: int = 40
) -> DataFrame:
    """One row per column: type, distinct values and a line describing them.

    Text columns with few and short values list all of them in order; the others
    show the first three in row order. ``order`` says which value was seen first; with a long it stays a
    hash aggregate.
    """
    texts = text_columns(df)
    positions = {c: i for i, c in enumerate(df.columns)}
    kinds = df.sparkSession.createDataFrame(
        [(positions[f.name], f.name, f.dataType.simpleString()) for f in df.schema.fields],
        "position int, column string, type string",
    )
    ordered = df.select(order.alias("_order"), *[quoted(c) for c in texts])
    # Read three times below, so the table is scanned once and its values are kept.
    values = stage(column_values(ordered, texts, first=F.min("_order")))
    sizes = values.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.avg(F.length("value")).alias("mean_length")
    )
    few = _first_values(values, [F.col("value")], enum_max, "all_values")
    seen = _first_values(values, [F.col("first"), F.col("value")], 3, "first_values")

    # Every side has one row per column of the table.
    facts = kinds.join(sizes, "column", "left").join(few, "column", "left").join(seen, "column", "left")
    is_text = F.col("type") == "string"
    n = F.coalesce("n_distinct", F.lit(0))
    listed = is_text & (n <= enum_max) & (F.coalesce("mean_length", F.lit(0.0)) <= val_maxlen)

    def joined(name: str) -> Column:
        items = F.coalesce(name, F.array().cast("array<string>"))
        return F.array_join(F.transform(items, lambda v: short_value(v, val_maxlen)), ", ")

    # Wording of the profile line.
    shown = short_value(F.col("column"), 10_000)
    line = (
        F.when(listed, F.concat(F.lit("- "), shown, F.lit(" (texte) valeurs: "), joined("all_values")))
        .when(
            is_text,
            F.concat(F.lit("- "), shown, F.lit(" (texte, "), n.cast("string"),
                     F.lit(" modalités, ex: "), joined("first_values"), F.lit(")")),
        )
        .otherwise(F.concat(F.lit("- "), shown, F.lit(" ("), F.col("type"), F.lit(")")))
    )
    return facts.select(
        "position",
        "column",
        "type",
        F.when(is_text, n).alias("n_distinct"),
        F.col("mean_length"),
        F.when(listed, F.col("all_values")).otherwise(F.col("first_values")).alias("examples"),
        line.alias("line"),
    )


def dropdown_domains(
    df: DataFrame, names: Sequence[str], limit: int = V.DROPDOWN_LIMIT
) -> DataFrame:
    """(column, values): the first ``limit`` distinct values of each column in order.

    A column without values has an empty list.
    """
    found = _first_values(column_values(df, names), [F.col("value")], limit, "values")
    # One row per name, so the side that is given is as short as the list of columns.
    every = df.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(names)], "column string")
    return every.join(found, "column", "left").withColumn("values", F.coalesce("values", F.array().cast(found.schema["values"].dataType)))


def most_frequent(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value): the mode of each column, the smallest value among equals."""
    best = Window.partitionBy("column").orderBy(F.desc("n"), F.col("value"))
    return (
        column_values(df, names)
        .withColumn("_nth", F.row_number().over(best))
        .where("_nth = 1")
        .select("column", "value")
    )
