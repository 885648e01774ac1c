"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from guichet.llm.text_bytes import forget
from guichet.session import on_workers

# A word, the same in Java, RE2 and Python: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_ROWS = 1000
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``step`` for ``mapInArrow``; free memory goes back to the machine when a task ends.

    Python workers serve later stages too, and what a finished task has freed would stay with
    them on top of what the next one takes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        forget()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of texts each; a longer text is a slice of its own."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            before = int(upto[low - 1]) if low else 0
            high = max(int(np.searchsorted(upto, before + most, "right")), low + 1)
            yield batch.slice(low, high - low)
            low = high


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started in this block send Python workers at most BATCH_ROWS rows at a time.

    Rows that carry texts or whole sets then take some MB a batch on either side.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def internal(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so other columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def count_words(text: Column) -> Column:
    """Number of words of a text; a null counts 0.

    Each word is cut to its first character and white space goes, so no list of words
    is made however long the text is.
    """
    first = F.regexp_replace(text, r"([^\x20\x09-\x0D])[^\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "$1")
    return F.coalesce(F.length(first), F.lit(0)).cast("long")


def fields(names: Iterable[str], types: Sequence[str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in zip(names, types))
