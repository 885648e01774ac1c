"""Delimited text: header repair, missing tokens, row order, newest snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from guichet.functions.text import map_columns, missing_to_null
from guichet.operators.settle import join_side, settle

ROW_ORD = "row_ord"
# Names of snapshots.
SNAPSHOTS = "apd_*.csv"


def unique_headers(names: Sequence[str | None]) -> list[str]:
    """Repeated names become ``name.1``, ``name.2``, …; empty ones ``Unnamed: i``."""
    taken: set[str] = set()
    counts: dict[str, int] = {}
    out = []
    for i, raw in enumerate(names):
        base = raw if raw else f"Unnamed: {i}"
        name = base
        while name in taken:
            counts[base] = counts.get(base, 0) + 1
            name = f"{base}.{counts[base]}"
        taken.add(name)
        out.append(name)
    return out


def file_order() -> Column:
    """Orders rows by file, by block of the file, then by line.

    Line numbers grow within a task, and a task reads a block from front to back.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value, at, header): the records of UTF-8 files, quoted line breaks included.

    ``at`` orders them (``file_order``), ``header`` marks the first of each file. Files are read in
    splits: whether a split begins inside quotes, and where that record began, follows from the
    quotes in the splits before it. Only lines of splits that hold a quoted break are brought
    together, by split, where their records are closed; records that go on in another split meet
    in one task each.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", file_order().alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.select("value", "at.*", (quotes % 2).alias("odd"))
    last_odd = F.max(F.when(F.col("odd") == 1, F.col("line")))
    blocks = settle(
        lines.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.min("line").alias("first"), last_odd.alias("last_odd"))
    )
    # One row per split.
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    is_open = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    at = F.struct("file", "block", "line")
    # The record that is open at the end of a split, if it began there.
    ends_open = (F.col("open") + F.col("odd")) % 2 == 1
    opened = F.when(ends_open & F.col("last_odd").isNotNull(), F.struct("file", "block", F.col("last_odd").alias("line")))
    states = settle(
        blocks.withColumn("open", is_open).withColumn("opened", opened).select(
            "file", "block", "open", "opened", ((F.col("open") == 0) & (F.col("odd") == 0)).alias("plain"),
            F.when(F.row_number().over(in_file) == 1, F.col("first")).alias("top"),
            F.last("opened", ignorenulls=True).over(earlier).alias("carried"),
        )
    )
    known = join_side(lines, states, ["file", "block"], "inner").withColumn("header", F.coalesce(F.col("line") == F.col("top"), F.lit(False)))
    plain = known.where("plain").select("value", at.alias("at"), "header")
    if states.where("NOT plain").isEmpty():
        return plain

    in_block = Window.partitionBy("file", "block").orderBy("line")
    quoted_before = F.coalesce(F.sum("odd").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = known.where("NOT plain").withColumn("inside", (F.col("open") + quoted_before) % 2)
    begins = F.last(F.when(F.col("inside") == 0, F.col("line")), ignorenulls=True)
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    # The records of a split; what they need is in its task already.
    pieces = (
        running.withColumn("begun", begins.over(upto)).groupBy("file", "block", "begun")
        .agg(
            F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines"), F.max("header").alias("header"),
            F.first("opened").alias("opened"), F.first("carried").alias("carried"),
        )
        .select(
            F.array_join(F.col("lines.value"), "\n").alias("value"), "file", "block", "header",
            F.when(F.col("begun").isNull(), F.col("carried")).otherwise(F.struct("file", "block", F.col("begun").alias("line"))).alias("at"),
            (F.col("begun").isNull() | F.coalesce(F.col("begun") == F.col("opened.line"), F.lit(False))).alias("across"),
        )
    )
    closed = pieces.where("NOT across").select("value", "at", "header")
    put_together = (
        pieces.where("across").groupBy("at")
        .agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"), F.max("header").alias("header"))
        .select(F.array_join(F.col("parts.value"), "\n").alias("value"), "at", "header")
    )
    return plain.unionByName(closed).unionByName(put_together)


def _parsed(rows: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """The data rows of ``records`` as columns, with their place ``at``."""
    value = F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    filled = rows.where("NOT header").select(value.alias("value"), "at").where(F.length("value") > 0)
    # A generator's output keeps filters above it, so a record is parsed once however many cells they ask for.
    parsed = F.array(F.from_csv("value", schema.simpleString(), options))
    cells = filled.select(F.explode(parsed).alias("cells"), "at")
    return cells.select(*[F.col("cells").getField(c).alias(c) for c in schema.names], "at")


def scan_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ";",
    encoding: str = "utf-8",
    multiline: bool = True,
    row_ord: str | None = ROW_ORD,
) -> DataFrame:
    """A header file as strings, with missing tokens as null.

    Nothing is inferred: casts are explicit steps. Files are read in splits. Quoted line breaks need
    ``multiline``, which passes over the quotes first; False spares that for files without
    them. Other encodings than UTF-8 are read in one task per file if they may have quoted
    breaks. All files must have the same header.
    """
    options = {
        "sep": sep,
        "encoding": "UTF-8" if encoding.lower() in ("utf-8-sig", "utf8", "utf-8") else encoding,
        "quote": '"',
        "escape": '"',
        "multiLine": multiline,
    }
    reader = spark.read.options(**options)
    first = reader.option("header", False).csv(path).first()
    if first is None:
        raise ValueError(f"no header in {path}")
    names = unique_headers([c.lstrip("\ufeff") if c else c for c in first])
    if multiline and options["encoding"] == "UTF-8":
        # Cells are named by place while they are parsed, whatever their names hold.
        places = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        df = _parsed(records(spark, path), places, options | {"multiLine": "true"})
        df = df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *([F.col("at").alias(row_ord)] if row_ord else []))
        return map_columns(df, names, missing_to_null)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = spark.read.options(**options).option("header", True).schema(schema).csv(path)
    if row_ord:
        df = df.withColumn(row_ord, file_order())
    return map_columns(df, names, missing_to_null)


def latest_file(spark: SparkSession, folder: str, pattern: str = SNAPSHOTS) -> str:
    """The last snapshot of a folder by name, a file or a folder of parts; contents are not read."""
    here = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = here.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(here).toString().rstrip("/")
    # What comes after the folder: the snapshot's name, and that of a part of it.
    name = F.split_part(F.substr("path", F.lit(len(full) + 2)), F.lit("/"), F.lit(1))
    try:
        files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{pattern}")
        latest = files.agg(F.max(name)).first()[0]
    except AnalysisException as missing:
        raise FileNotFoundError(f"no {pattern} in {folder}") from missing
    if latest is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return f"{folder.rstrip('/')}/{latest}"


def scan_latest(
    spark: SparkSession, folder: str, pattern: str = SNAPSHOTS, **options
) -> DataFrame:
    """The newest snapshot: names carry the hour, so the last name is the newest."""
    return scan_delimited(spark, latest_file(spark, folder, pattern), **options)


def scan_clean_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = True
) -> DataFrame:
    """A comma file written by ``write_csv``, with the types it had.

    Text without line breaks needs one pass less with ``multiline=False``.
    """
    options = {"sep": ",", "quote": '"', "escape": '"'}
    if not multiline:
        return spark.read.schema(schema).options(header=True, **options).csv(path)
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    places = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    df = _parsed(records(spark, path), places, options | {"multiLine": "true"})
    return df.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)])
