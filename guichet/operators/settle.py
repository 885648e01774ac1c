"""Derived tables: writing them down, checking their size, joining them back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from guichet.functions.text import quoted
from guichet.session import ensure_checkpoint_dir, owned, shared_folder

# A side table is broadcast only if it was counted and stays below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
# A key is hot above this share of all rows, so at most HOT_KEYS keys are hot.
HOT_KEYS = 1000
# Rows of a task in a join of two long tables.
TASK_ROWS = 500_000
# A series up to this length may be ordered in one task.
SERIES_ROWS = 100_000


def settle(df: DataFrame) -> DataFrame:
    """Write a small derived table to the shared checkpoint folder and read it from there.

    What follows sees the same rows however often tasks are rerun.
    """
    ensure_checkpoint_dir(df.sparkSession)
    written = df.checkpoint(eager=True)
    file = written._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        owned(file.get())
    return written


def stage(df: DataFrame, **options: str) -> DataFrame:
    """The same for tables as long as the data: Parquet, so later steps read only the
    columns they use."""
    folder = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a table written in this block has shuffled is deleted as soon as the table is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _size(df: DataFrame):
    row = F.to_json(F.struct(*[quoted(c) for c in df.columns]))
    bytes_ = F.coalesce(F.sum(F.length(row)), F.lit(0))
    return (F.count(F.lit(1)) <= BROADCAST_ROWS) & (bytes_ <= BROADCAST_BYTES)


def is_small(df: DataFrame) -> bool:
    """Whether a settled table may be broadcast."""
    return df.agg(_size(df).alias("small")).first()["small"]


def large_parts(df: DataFrame, by: str) -> set[str]:
    """The values of ``by``, a column with few values, whose rows are too many to broadcast."""
    parts = df.groupBy(quoted(by)).agg(_size(df).alias("small"))
    return {row[by] for row in parts.where("NOT small").collect()}


def is_short(df: DataFrame) -> bool:
    """Whether a settled series may be ordered in one task."""
    return df.count() <= SERIES_ROWS


def join_side(df: DataFrame, side: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join a settled table: broadcast if it is small, else by shuffle."""
    return df.join(F.broadcast(side) if is_small(side) else side, list(on), how)


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys that hold more than a thousandth of the rows, null keys apart."""
    keys = [quoted(c) for c in on]
    n = df.count()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return settle(counts.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in keys]) & (F.col("_rows") * HOT_KEYS > n)).drop("_rows"))


def by_key(df: DataFrame, on: Sequence[str], rows: int) -> DataFrame:
    """``df`` shuffled by key into tasks of so many rows that each sorts few of the ``rows``.

    Left to itself a shuffle makes partitions by their packed bytes, and those of numbers that run on or
    of like texts hold ten times as much once they are sorted.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(tasks, *[quoted(c) for c in on])


def attach(
    df: DataFrame, fitted: DataFrame, on: Sequence[str], small: bool | None = None
) -> DataFrame:
    """Left join of a settled table that has one row per key.

    A small table is broadcast. A large one is joined by shuffle, apart from the
    rows of hot keys and of null keys: hot keys are few by definition, so their
    rows of ``fitted`` are broadcast and the rows of ``df`` stay where they are;
    null keys match nothing and skip the join; the others go to tasks of bounded
    length. ``small`` is the outcome of an earlier size check on a table that contains
    ``fitted``.
    """
    on = list(on)
    if is_small(fitted) if small is None else small:
        return df.join(F.broadcast(fitted), on, "left")

    keys = [quoted(c) for c in on]
    df = df.select(*keys, *[quoted(c) for c in df.columns if c not in on])
    has_key = reduce(lambda a, b: a & b, [c.isNotNull() for c in keys])

    counts = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    totals = counts.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("all"),
        F.coalesce(F.sum(F.when(~has_key, F.col("_rows"))), F.lit(0)).alias("without_key"),
    ).first()
    hot = settle(counts.where(has_key & (F.col("_rows") * HOT_KEYS > totals["all"])).drop("_rows"))

    keyed_rows = df.where(has_key)
    # A side table may be longer than what it is joined to.
    rows = max(totals["all"] - totals["without_key"], fitted.count())
    parts = []
    if hot.isEmpty():
        parts.append(by_key(keyed_rows, on, rows).join(by_key(fitted, on, rows), on, "left"))
    else:
        hot_side = settle(fitted.join(F.broadcast(hot), on, "left_semi"))
        parts.append(
            keyed_rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_side), on, "left")
        )
        rest = keyed_rows.join(F.broadcast(hot), on, "left_anti")
        parts.append(by_key(rest, on, rows).join(by_key(fitted, on, rows), on, "left"))
    if totals["without_key"]:
        added = [f for f in fitted.schema.fields if f.name not in on]
        parts.append(
            df.where(~has_key).select(
                *[quoted(c) for c in df.columns],
                *[F.lit(None).cast(f.dataType).alias(f.name) for f in added],
            )
        )
    return reduce(DataFrame.unionByName, parts)
