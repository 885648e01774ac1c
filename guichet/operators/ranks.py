"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from guichet.operators.settle import settle, stage

_SLOT_BITS = 33  # monotonically_increasing_id: partition above, row below


def number_rows(
    df: DataFrame, order: Sequence[Column], name: str = "position"
) -> tuple[DataFrame, int]:
    """(table with 0-based positions in ``order``, number of rows).

    Range partitions are sorted separately and written out; each row's position is
    its place in its partition plus the rows of the partitions before. ``order``
    has to be a total order, which also lets a hot leading value be split.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    slots = stage(spread.withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright("_slot", _SLOT_BITS)

    # One row per partition.
    sizes = slots.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = settle(
        sizes.select("_part", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    n = starts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    numbered = (
        slots.withColumn("_part", part)
        .join(F.broadcast(starts.drop("_rows")), "_part")
        .withColumn(name, F.col("_start") + F.col("_slot").bitwiseAND((1 << _SLOT_BITS) - 1))
        .drop("_part", "_start", "_slot")
    )
    return numbered, n
