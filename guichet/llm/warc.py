"""WARC archives: writing them, and reading them in splits by boundary chains."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from guichet.llm.common import internal, on_workers, tidy
from guichet.operators.settle import join_side, settle, stage
from guichet.session import shared_folder

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAGE = "urn:x-page:"
# Payloads of fewer bytes are always written in full.
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a SHA-1 given in hex: five hex digits are four letters."""
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(value, shift).bitwiseAND(31) + 1
            letters.append(F.substring(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*letters)


def record_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` with ``bytes, digest, record_type, refers_to``, from ``id, url, html``.

    Only digests that occur twice are gathered, reduced in every task first.
    """
    pages = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("bytes", F.octet_length("html").cast("long"))
    pages = pages.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    shared = stage(
        pages.where(F.col("bytes") >= min_bytes)
        .groupBy("sha1")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("sha1", "first")
    )
    revisits = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return join_side(pages, shared, ["sha1"], "left").select(
        "id", "url", "html", "bytes",
        base32_of_hex(F.col("sha1")).alias("digest"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first")).alias("refers_to"),
    )


def write_archive(
    pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, date: str = DATE,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """Write a WARC record per row of ``pages`` into files under ``folder``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest id
    is a response and the others revisit it; smaller payloads are all responses. A null payload
    is empty. Rows that repeat the smallest id are responses too. A row without an id revisits
    any equal row that has one, else it is a response. Line breaks in a url are escaped, a null
    url has no header line. Other columns are ignored whatever their names.

    A record is a row of Spark's text writer, whose line separator is the end of a record, so
    files are committed like any others and a lost task is written again.
    """
    rows = record_types(internal(pages, id=id_col, url=url_col, html=html_col), min_bytes)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    is_response = F.col("record_type") == "response"
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.concat(F.lit(f"<{PAGE}"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(is_response, F.lit("")).otherwise(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n")
        ),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.length("http") + F.when(is_response, F.col("bytes")).otherwise(0)).cast("string")),
        F.lit("\r\n"),
        F.col("http"),
        F.when(is_response, F.col("html")).otherwise(F.lit("")),
    )
    rows.withColumn("http", http).select(record.alias("value")).write.option("lineSep", END).text(folder)


_LENGTH = re.compile(rb"^Content-Length:[ \t]*(\d+)[ \t]*\r?$", re.M | re.I)
_TYPE = re.compile(rb"^WARC-Type:[ \t]*([^\r\n]+?)[ \t]*\r?$", re.M | re.I)
_ID = re.compile(rb"^WARC-Record-ID:[ \t]*<" + PAGE.encode() + rb"(-?\d+)>", re.M | re.I)
_REFERS = re.compile(rb"^WARC-Refers-To:[ \t]*<" + PAGE.encode() + rb"(-?\d+)>", re.M | re.I)
_DIGEST = re.compile(rb"^WARC-Payload-Digest:[ \t]*sha1:([A-Z2-7]+)", re.M | re.I)

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
CANDIDATE = f"file string, split long, place long, length long, needed long, whole boolean, {RECORD}"


def _needed(content: bytes) -> tuple[int, int] | None:
    """Bytes of the header and of the whole record after the magic, up to its end mark."""
    header = content.find(b"\r\n\r\n")
    if header < 0:
        return None
    length = _LENGTH.search(content, 0, header + 2)
    if length is None:
        return None
    return header + 4, header + 4 + int(length[1]) + 4


def _record(content: bytes, header: int, end: int) -> tuple:
    """What a record says: id, payload size and digest, type, and what it revisits."""
    find = lambda pattern: (m := pattern.search(content, 0, header)) and m[1]
    page, refers, kind, digest = find(_ID), find(_REFERS), find(_TYPE), find(_DIGEST)
    body = content[header : end - 4]
    http = body.find(b"\r\n\r\n") + 4
    payload = body[http:] if http >= 4 else body
    kind = kind.decode().lower() if kind else None
    if kind == "revisit":
        full = _LENGTH.search(body, 0, max(http - 2, 0))
        size, digest = (int(full[1]) if full else None), digest.decode() if digest else None
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return int(page) if page else None, size, digest, kind, int(refers) if refers else None


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The files cut at every magic, with the file and split that each piece came from."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("content"),
    )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece its place within its split, and where its record would end."""
    at, place = None, 0
    names = [c.split(" ")[0] for c in CANDIDATE.split(", ")]
    for batch in batches:
        rows = []
        for file, split, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (file, split) != at:
                at, place = (file, split), 0
            needed = None if split == 0 and place == 0 else _needed(content)
            whole = needed is not None and len(content) >= needed[1] - 4
            record = _record(content, *needed) if whole else (None,) * 5
            rows.append((file, split, place, len(content), needed and needed[1], whole, *record))
            place += len(content) + len(MAGIC)
        yield pa.RecordBatch.from_pydict(
            {n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=_schema(CANDIDATE)
        )


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in ddl.split(", ")])


def _exits(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one split: per candidate the first offset behind the split that its chain reaches."""
    frame = frame.sort_values("offset")
    offsets, successors = frame["offset"].to_numpy(), frame["successor"].to_numpy()
    behind = int(frame["behind"].iloc[0])
    exits = np.full(len(frame), -1, np.int64)
    places = np.searchsorted(offsets, successors)
    for i in range(len(frame) - 1, -1, -1):
        if successors[i] >= behind:
            exits[i] = successors[i]
        elif places[i] < len(offsets) and offsets[places[i]] == successors[i]:
            exits[i] = exits[places[i]]
    return pd.DataFrame({"file": frame["file"], "offset": offsets, "exit": exits})


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one split: the candidates on the chain from the offset at which it is entered."""
    frame = frame.sort_values("offset")
    offsets, successors = frame["offset"].to_numpy(), frame["successor"].to_numpy()
    places = np.searchsorted(offsets, successors)
    reached = frame["entry"].to_numpy(bool).copy()
    for i in range(len(frame)):
        if reached[i] and places[i] < len(offsets) and offsets[places[i]] == successors[i]:
            reached[places[i]] = True
    return frame[reached][["file", "split", "place", "offset", "successor"]]


def _reached_entries(exits: DataFrame) -> DataFrame:
    """``file, offset`` at which the chains that begin with each file enter its splits.

    Pointer jumping: each round doubles how far the pointers reach, so a file of n splits
    takes about log2(n) rounds, over one row a split.
    """
    starts = exits.where("offset = 0").select("file", "offset")
    targets = exits.where("exit >= 0").select("file", F.col("exit").alias("offset")).distinct()
    entries = starts.unionByName(targets).distinct()
    jump = settle(exits.where("exit >= 0").join(entries, ["file", "offset"], "left_semi"))
    jump = settle(jump.join(jump.select("file", F.col("offset").alias("exit")), ["file", "exit"], "left_semi").select("file", "offset", "exit"))
    reached = settle(starts)
    n = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = settle(reached.unionByName(ahead).distinct())
        more = reached.count()
        if more == n:
            return reached
        n = more
        second = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("far"))
        jump = settle(jump.join(second, ["file", "exit"]).select("file", "offset", F.col("far").alias("exit")))


def _assemble(frame: pd.DataFrame) -> pd.DataFrame:
    """One record whose payload holds the magic, put together from its pieces."""
    content = MAGIC.encode().join(frame.sort_values("offset")["content"])
    needed = _needed(content)
    if needed is None or len(content) < needed[1] - 4:
        return pd.DataFrame({c.split(" ")[0]: [] for c in RECORD.split(", ")})
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    return pd.DataFrame([_record(content, *needed)], columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    The files are read in splits and cut at every magic. Each piece is a candidate for a
    record and says where its successor would begin. The places of pieces become offsets by
    adding up the splits before. A split resolves its own chains; pointer jumping over the
    splits finds those that begin with the file, and only their records are kept, so a magic
    inside a payload is rejected. Such a payload is put together again from its pieces.
    Size and digest of a response are those of the bytes read. A damaged file gives the
    records before the damage, an empty one none.
    """
    on_workers(spark)
    pieces = _pieces(spark, folder)
    found = stage(pieces.mapInArrow(tidy(_candidates), CANDIDATE))
    upto = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = settle(
        found.groupBy("file", "split")
        .agg(F.sum(F.col("length") + len(MAGIC)).alias("total"))
        .withColumn("base", F.coalesce(F.sum("total").over(upto), F.lit(0)) - len(MAGIC))
        .withColumn("behind", F.col("base") + F.col("total"))
    )
    placed = join_side(found, splits, ["file", "split"], "inner").withColumn("offset", F.col("base") + F.col("place"))
    chain = placed.where("needed IS NOT NULL").select(
        "file", "split", "place", "offset", "behind",
        (F.col("offset") + len(MAGIC) + F.col("needed")).alias("successor"),
    )
    exits = stage(chain.groupBy("file", "split").applyInPandas(_exits, "file string, offset long, exit long"))
    entries = _reached_entries(exits).withColumn("entry", F.lit(True))
    entered = chain.join(entries, ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    kept = stage(
        entered.groupBy("file", "split").applyInPandas(_walk, "file string, split long, place long, offset long, successor long")
    )
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    records = found.join(kept, ["file", "split", "place"])
    whole = records.where("whole").select(*names)

    broken = stage(records.where("NOT whole").select("file", "offset", "successor"))
    if broken.isEmpty():
        return whole
    # The pieces of a record lie between its offset and its successor.
    owners = Window.partitionBy("file").orderBy("offset")
    marked = (
        placed.join(broken.select("file").distinct(), "file", "left_semi")
        .select("file", "split", "place", "offset")
        .join(kept.select("file", "offset", F.col("offset").alias("own"), "successor"), ["file", "offset"], "left")
        .withColumn("owner", F.last("own", ignorenulls=True).over(owners))
        .withColumn("upto", F.last("successor", ignorenulls=True).over(owners))
        .where("offset < upto")
    )
    parts = settle(
        marked.join(broken.select("file", F.col("offset").alias("owner")), ["file", "owner"], "left_semi")
        .select("file", "split", "place", "offset", "owner")
    )
    joined = join_side(pieces.mapInArrow(tidy(_with_place), "file string, split long, place long, content binary"), parts, ["file", "split", "place"], "inner")
    return whole.unionByName(joined.groupBy("file", "owner").applyInPandas(_assemble, RECORD))


def _with_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, place = None, 0
    for batch in batches:
        places = []
        for file, split, content in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, split) != at:
                at, place = (file, split), 0
            places.append(place)
            place += len(content) + len(MAGIC)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(places, pa.int64()), batch.column(2)], ["file", "split", "place", "content"]
        )


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, **columns: str) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    folder = shared_folder(pages.sparkSession)
    write_archive(pages, folder, min_bytes, **columns)
    return read_archive(pages.sparkSession, folder)
