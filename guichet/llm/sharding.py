"""Sharding by a two-pass external shuffle, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from guichet.operators.settle import settle, stage

SHARDS = 16
SEED = 20240611
# A bucket holds at most about this much text, or more once there would be over MOST_BUCKETS of
# them: it has to fit in the memory of a task several times.
BUCKET_BYTES = 16 << 20
# Tables with a row per bucket stay below this length, so they may be broadcast and summed up in
# one task.
MOST_BUCKETS = 1 << 18
# Copies of a row that are dealt out by one task at a time.
COPIES = 10_000


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _cell(key: Column) -> Column:
    return F.pmod(key, F.lit(MOST_BUCKETS)).cast("int")


def _counted(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def _copies_apart(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` again, every copy of a row under a key of its own.

    Copies are counted in every task before the shuffle and numbered when they are dealt out, so
    the keys are the same whatever task has which copy.
    """
    counted = rows.groupBy("row", "size", "key").agg(F.count(F.lit(1)).alias("n"))
    chunks = counted.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    upto = F.least(F.col("from") + COPIES, F.col("n")) - 1
    return (
        chunks.repartition("key", "from")
        .withColumn("copy", F.explode(F.sequence("from", upto)))
        .select("row", "size", _hash(seed + 1, F.col("key"), F.col("copy")).alias("key"))
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, text_col: str = "text",
    shard_col: str = "shard", slot_col: str = "slot", bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Shuffle the whole table into ``shards`` shards under ``path`` and read them from there.

    The first pass scatters every record to a bucket by a seeded hash of all its columns; a
    bucket fits in memory. The second pass shuffles each bucket (Fisher-Yates, Spark's
    ``shuffle``) and writes it. The buckets one after another are the shuffled table, which is
    cut into shards whose row counts differ by at most one. A shard is the folder
    ``shard=<number>``; its files in the order of their names hold its rows in order, and
    ``slot`` numbers them from 0. Gives all columns of ``docs``, ``slot_col`` and ``shard_col``.

    Copies of a row (equal in every column) have the same hash. A bucket that they make larger
    than memory is scattered a second time, each copy under a hash of its own. So the result
    depends on the rows and the parameters alone: not on files, partitions, reruns or other
    settings.

    A null text counts no bytes; nulls elsewhere are values like others. Empty texts and repeated rows
    are kept. A text longer than a bucket is one record in one bucket. Columns called like
    the new ones give way to them. An empty table has no shards and gives no rows. Columns of a
    map type cannot be hashed and are refused by Spark.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in (shard_col.lower(), slot_col.lower())]
    columns = [F.col(f"`{c}`") for c in names]
    rows = docs.select(
        F.struct(*columns).alias("row"),
        (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("long").alias("size"),
        _hash(seed, *columns).alias("key"),
    )

    # First pass: how many rows and bytes there are, in cells that buckets are made of.
    cells = settle(_counted(rows.withColumn("cell", _cell(F.col("key"))), "cell"))
    total = cells.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = 1
    while buckets < MOST_BUCKETS and total > buckets * bucket_bytes:
        buckets *= 2

    def in_buckets(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(_cell(F.col("key")), F.lit(buckets)).cast("int"))

    counts = cells.groupBy(F.pmod("cell", F.lit(buckets)).cast("int").alias("bucket")).agg(
        F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")
    )
    records = in_buckets(rows)
    room = max(bucket_bytes, total / buckets)
    swollen = settle(counts.where(F.col("bytes") > 2 * room).select("bucket"))
    if not swollen.isEmpty():
        spread = in_buckets(stage(_copies_apart(records.join(F.broadcast(swollen), "bucket", "left_semi"), seed)))
        records = records.join(F.broadcast(swollen), "bucket", "left_anti").select(*spread.columns).unionByName(spread)
        counts = (
            counts.join(F.broadcast(swollen), "bucket", "left_anti").select("bucket", "rows")
            .unionByName(_counted(spread, "bucket").select("bucket", "rows"))
            .groupBy("bucket").agg(F.sum("rows").alias("rows"))
        )
    before = Window.partitionBy(F.lit(1)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.select("bucket", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")))
    n = starts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    # Second pass: a task has one bucket, the one of its number.
    position = F.col("start") + F.col("place")
    shuffled = (
        records.select("bucket", F.struct("key", "row").alias("record"))
        .repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records"))
        .join(F.broadcast(starts.select("bucket", "start")), "bucket")
        .select("start", F.shuffle("records", seed).alias("records"))
        .select("start", F.posexplode("records").alias("place", "record"))
        .select("record.row.*", position.alias("position"))
        .withColumn(shard_col, F.expr(f"position * {shards} div {max(n, 1)}").cast("int"))
        .withColumn(slot_col, F.expr(f"position - (`{shard_col}` * {n}L + {shards - 1}) div {shards}"))
        .drop("position")
    )
    shuffled.sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)
    return spark.read.schema(shuffled.schema).parquet(path)
