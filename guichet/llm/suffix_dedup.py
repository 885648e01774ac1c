"""Repeated passages by sparse suffix arrays over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from guichet.llm.common import internal, on_workers, tidy
from guichet.llm.text_bytes import groups, windows, words
from guichet.operators.ranks import number_rows
from guichet.operators.settle import join_side, settle, stage

# Passages of at least this many words that occur in another document are found.
MIN_WORDS = 50
# Of every REACH neighbouring grams of GRAM words the one with the smallest hash is kept.
GRAM = 8
REACH = 10
# A passage holds a kept position among its first REACH, so this many words follow it there.
CORE = MIN_WORDS - REACH + 1
# Sorted suffixes that a task compares at a time.
BLOCK = 1 << 16
# Beyond its core a match can go on for fewer than REACH words without another kept position.
BEYOND = REACH - 1


def minimisers(grams: np.ndarray) -> np.ndarray:
    """Positions that hold the smallest of some REACH neighbouring grams, the first of equal ones."""
    if len(grams) < REACH:
        return np.zeros(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(grams, REACH)
    picked = np.zeros(len(grams), bool)
    for at in range(0, len(seen), 1 << 16):
        part = seen[at : at + (1 << 16)]
        picked[part.argmin(axis=1) + np.arange(at, at + len(part))] = True
    return np.flatnonzero(picked)


def anchors(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text its kept positions, the hash of the CORE words from each, and all word hashes."""
    for _, _, data, offsets in groups(texts):
        found = words(data, offsets)
        grams, cores = windows(found.hashes, GRAM), windows(found.hashes, CORE)
        for a, b in zip(found.first[:-1], found.first[1:]):
            if b - a < CORE:
                yield np.zeros(0, np.int64), np.zeros(0, np.uint64), found.hashes[a:b]
                continue
            kept = minimisers(grams[a : b - GRAM + 1])
            kept = kept[kept <= b - a - CORE]
            yield kept, cores[a + kept], found.hashes[a:b]


def _anchored(docs: DataFrame) -> DataFrame:
    """``core, doc, place`` of every kept position."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cores, docs_, places, size = [], [], [], 0
            for i, (kept, hashes, _) in enumerate(anchors(batch.column(1))):
                cores.append(hashes.view(np.int64))
                docs_.append(np.full(len(kept), ids[i]))
                places.append(kept.astype(np.int32))
                size += len(kept)
                if size > 1 << 18:
                    yield _batch(cores, docs_, places)
                    cores, docs_, places, size = [], [], [], 0
            yield _batch(cores, docs_, places)

    return docs.mapInArrow(tidy(find), "core long, doc long, place int")


def _batch(cores: list, docs: list, places: list) -> pa.RecordBatch:
    columns = [np.concatenate([np.zeros(0, kind), *parts]) for parts, kind in ((cores, np.int64), (docs, np.int64), (places, np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["core", "doc", "place"])


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows``, which have ``doc, start, stop``, with the number of their ``run``: overlapping
    or touching ones of a document are one."""
    before = Window.partitionBy("doc").orderBy("start", "stop")
    far = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = (far.isNull() | (F.col("start") > far)).cast("int")
    number = F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("opens", opens).withColumn("run", number).drop("opens")


def _runs(rows: DataFrame) -> DataFrame:
    """``rows(doc, start, stop)`` with those of a run joined."""
    return _numbered(rows).groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _near_ends(kept: DataFrame) -> DataFrame:
    """``core, doc, place, first, last`` of the kept positions fewer than REACH words from the
    first or the last one of their run. Every run has some, its first and last among them."""
    run = Window.partitionBy("doc", "run")
    rows = _numbered(kept.select("core", "doc", F.col("place").alias("start"), (F.col("place") + CORE).alias("stop")))
    return (
        rows.withColumn("first", F.min("start").over(run))
        .withColumn("last", F.max("start").over(run))
        .where((F.col("start") < F.col("first") + REACH) | (F.col("start") > F.col("last") - REACH))
        .select("core", "doc", F.col("start").alias("place"), "first", "last")
    )


def _common(a: str, b: str) -> Column:
    """Length of the common beginning of two arrays."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


def _nearest_of_others(rows: DataFrame, n: int, name: str, forward: bool) -> DataFrame:
    """``rows`` with the context of the nearest suffix before (or behind) it that has the same core
    and is of another document, as ``struct<context>``, null where there is none.

    ``position`` numbers the ``n`` rows in order. They are taken in blocks; what a block begins
    with follows from the last rows of the blocks before it.
    """
    nearest = F.col("position") if forward else F.col("position").desc()
    in_block = Window.partitionBy("block").orderBy(nearest)
    here = F.struct("core", "doc", "context")
    rows = rows.withColumn("before", F.lag(here).over(in_block))

    def seen(before: Column, row: Column) -> Column:
        """What a run of suffixes of one document and core sees before itself."""
        other = (before["core"] != row["core"]) | (before["doc"] != row["doc"])
        return F.when(other, F.struct(F.when(before["core"] == row["core"], before["context"]).alias("context")))

    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.last(seen(F.col("before"), here), ignorenulls=True).over(upto)).drop("before")

    # One row per block.
    low, high = F.col("position") % BLOCK == 0, (F.col("position") % BLOCK == BLOCK - 1) | (F.col("position") == n - 1)
    firsts = rows.where(low if forward else high).select("block", here.alias("first"))
    lasts = rows.where(high if forward else low).select("block", here.alias("last"), F.col(name).alias("inside"))
    blocks = stage(firsts.join(lasts, "block"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("block") if forward else F.col("block").desc())
    entries = blocks.withColumn("own", seen(F.lag("last").over(order), F.col("first")))
    passed_on = F.last(F.coalesce("inside", "own"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    entries = settle(entries.select("block", F.coalesce("own", passed_on).alias("entry")))
    return join_side(rows, entries, ["block"], "inner").withColumn(name, F.coalesce(F.col(name), F.col("entry"))).drop("entry")


def _agreement(suffixes: DataFrame, context: str) -> DataFrame:
    """``core, doc, place, n``: how many words of ``context`` each suffix has in common with
    the nearest ones of other documents before and behind it among the suffixes of its core,
    in sorted order.

    The order is spread over range partitions and then over blocks, so a core of many suffixes is
    split too.
    """
    rows = suffixes.select("core", F.col(context).alias("context"), "doc", "place")
    sorted_, n = number_rows(rows, [F.col(c) for c in ("core", "context", "doc", "place")], "position")
    sorted_ = stage(sorted_.withColumn("block", F.floor(F.col("position") / BLOCK).cast("long")))
    both = _nearest_of_others(_nearest_of_others(sorted_, n, "lower", True), n, "upper", False)
    common = [F.coalesce(_common("context", f"{side}.context"), F.lit(0)) for side in ("lower", "upper")]
    return both.select("core", "doc", "place", F.greatest(*common).alias("n"))


def _with_context(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``core, doc, place`` of the wanted positions with the words to their left, nearest
    first, and the words behind their core, as hashes."""
    per_doc = settle(wanted.groupBy("doc").agg(F.array_sort(F.collect_set("place")).alias("places")))
    texts = join_side(docs, per_doc.withColumnRenamed("doc", "id"), ["id"], "inner").select("id", "text", "places")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, wanted_ = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, (kept, cores, hashes) in enumerate(anchors(batch.column(1))):
                words_ = hashes.view(np.int64)
                place_of = dict(zip(kept.tolist(), cores.view(np.int64).tolist()))
                for p in wanted_[i]:
                    if p in place_of:
                        left = words_[max(p - BEYOND, 0) : p][::-1].tolist()
                        right = words_[p + CORE : p + CORE + BEYOND].tolist()
                        rows.append((place_of[p], ids[i], p, left, right))
            names = ["core", "doc", "place", "left", "right"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(5)], names)

    return texts.mapInArrow(tidy(look), "core long, doc long, place int, left array<long>, right array<long>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start_word, end_word, n_words`` of every passage of at least MIN_WORDS words
    that other documents have too; words are counted from 0, ``end_word`` is the one behind.

    Kept positions are chosen by the words around them, so equal passages keep equal
    positions and the suffix array needs only about a sixth of them. Suffixes that share
    their first CORE words with another document are found by a hash, reduced in every task.
    Their positions join to runs in each document. Near the two ends of a run the suffixes of
    the same core are sorted by what goes on behind them, and by what comes before them, and
    each is extended as far as it agrees with the nearest suffix of another document on either
    side; the run goes as far as any of them, as the outermost may be shared with other
    documents than the next. So a hash of CORE words finds the matches, and the sorted suffixes say
    how far they reach. Any 50 words that another document has are found, and every CORE words of a
    passage are in another document. Cores are named by 64-bit hashes. Ids are whole numbers.

    A null, empty or short text has no passage. Rows of one id are taken as one document, so
    repeated rows alone are no repeats. A row without an id takes no part. Other columns are
    ignored whatever their names. Texts are compared word by word; white space does not matter.
    """
    on_workers(docs.sparkSession)
    docs = internal(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).where("id IS NOT NULL")
    shared = stage(
        _anchored(docs).groupBy("core").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("core")
    )
    kept = stage(join_side(_anchored(docs), shared, ["core"], "left_semi").distinct())
    near = stage(_near_ends(kept))
    end_cores = settle(near.select("core").distinct())
    suffixes = stage(_with_context(docs, join_side(kept, end_cores, ["core"], "left_semi")).distinct())
    to_left = _agreement(suffixes, "left").groupBy("doc", "place").agg(F.max("n").alias("before"))
    to_right = _agreement(suffixes, "right").groupBy("doc", "place").agg(F.max("n").alias("behind"))
    spans = (
        near.join(to_left, ["doc", "place"], "left")
        .join(to_right, ["doc", "place"], "left")
        .groupBy("doc", "first", "last")
        .agg(
            F.min(F.col("place") - F.coalesce("before", F.lit(0))).alias("start"),
            F.max(F.col("place") + CORE + F.coalesce("behind", F.lit(0))).alias("stop"),
        )
        .select("doc", "start", "stop")
        .where(F.col("stop") - F.col("start") >= MIN_WORDS)
    )
    return _runs(spans).select(
        F.col("doc").alias(id_col),
        F.col("start").alias("start_word"),
        F.col("stop").alias("end_word"),
        (F.col("stop") - F.col("start")).alias("n_words"),
    )
