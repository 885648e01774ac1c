"""Parquet, CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{folder.rstrip('/')}/{name}.parquet")


def _plain(path: str) -> str:
    """A path without the file scheme, the form in which inputs and outputs compare."""
    for scheme in ("file://", "file:"):
        if path.startswith(scheme):
            path = path[len(scheme):]
            break
    return "/" + path.strip("/") if path.startswith("/") else path.rstrip("/")


def _check_output(df: DataFrame, path: str) -> None:
    """Overwriting a folder that is being read would destroy the input."""
    spark = df.sparkSession
    wanted = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = wanted.getFileSystem(spark._jsc.hadoopConfiguration())
    # Relative paths and paths without a scheme are made full, as those of inputs are.
    out = _plain(system.makeQualified(wanted).toString())
    for used in df.inputFiles():
        used = _plain(used)
        if used == out or used.startswith(out + "/"):
            raise ValueError(f"{path} is an input of this table")


def write_parquet(df: DataFrame, path: str) -> None:
    _check_output(df, path)
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    _check_output(df, path)
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A short table (metrics, model metadata, dropdowns) as one JSON file."""
    _check_output(df, path)
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)
