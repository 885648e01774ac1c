"""Running the hourly job when a new snapshot arrives.

Snapshots replace each other in full, so there is no state to carry: the stream only
notices new files, and the job reads the newest one as a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from guichet.sources.delimited import SNAPSHOTS, latest_file, scan_delimited


def refresh_on_snapshot(
    spark: SparkSession,
    folder: str,
    job: Callable[[DataFrame], None],
    checkpoint: str,
    pattern: str = SNAPSHOTS,
    every: str | None = None,
    **scan_options,
) -> StreamingQuery:
    """Call ``job`` with the newest snapshot once per arrival of files.

    ``every`` is the trigger interval, for example ``"1 hour"``; without it the query
    handles what has arrived since its last run and stops, for an outside scheduler.
    ``checkpoint`` is a folder shared by all executors. Only file names are read
    from the stream.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path")
    )

    def run(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        newest = latest_file(batch.sparkSession, folder, pattern)
        job(scan_delimited(batch.sparkSession, newest, **scan_options))

    writer = arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
