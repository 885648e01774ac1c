"""How far the sources of a language are from each other in the words they use."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from guichet.llm.common import internal, on_workers, tidy
from guichet.operators.ranks import number_rows
from guichet.operators.settle import attach, join_side, settle, stage

MIN_DOCS = 30
# A probability is one plus the whole part of SCALE * (count + PRIOR) / (N + PRIOR * V).
SCALE = 1_000_000_000
PRIOR = 5
TOP_TERMS = 50
# Terms and sources that a task compares at a time.
BLOCK_TERMS = 2048
TILE = 128
# Bytes of a text that are split at a time, and terms a task holds before it hands them on.
PIECE_BYTES = 1 << 20
HELD_TERMS = 300_000

# Letters to lower case; every other ASCII character is a separator.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ONE_DOC, MASK = 1 << 64, (1 << 64) - 1
_RAW_SEPARATOR = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def term_counts(text: bytes) -> Counter:
    """The terms of a text and how often it has them.

    A long text is cut at separators, so its list of words is never held as a whole.
    """
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > PIECE_BYTES:
            cut = _RAW_SEPARATOR.search(text, at + PIECE_BYTES)
            stop = cut.start() if cut else stop
        counts.update(text[at:stop].translate(TABLE).split())
        at = stop
    return counts


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``number, lang, term, n, docs`` of the texts of groups, summed up as far as memory allows."""
    # Occurrences in the lower bits, documents above them.
    held: dict[tuple[int, int], dict[bytes, int]] = {}
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (number, lang), terms in held.items():
            sums = terms.values()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(terms), number)), pa.array(np.full(len(terms), lang)),
                    pa.array(list(terms), pa.binary()).cast(pa.string()),
                    pa.array(np.fromiter((s & MASK for s in sums), np.int64, len(terms))),
                    pa.array(np.fromiter((s >> 64 for s in sums), np.int64, len(terms))),
                ],
                ["number", "lang", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        for number, lang, text in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2)):
            group = held.setdefault((number, lang), {})
            before = len(group)
            have = group.get
            for term, n in term_counts(text.as_buffer().to_pybytes()).items():
                group[term] = have(term, 0) + n + ONE_DOC
            size += len(group) - before
            if size > HELD_TERMS:
                yield from hand_on()
                size = 0
    yield from hand_on()


def _share(count: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)) in whole numbers; 0 without terms."""
    return F.expr(
        f"if({terms} = 0, 0L, 1L + (cast(({count} + {PRIOR}) as decimal(19, 0)) * {SCALE}) "
        f"div cast({total} + {PRIOR} * {terms} as decimal(19, 0)))"
    )


def _distances(frame: pd.DataFrame) -> pd.DataFrame:
    """Summed differences of the sources of two tiles over the terms of a block that occur in them,
    and how many those are.

    A row without a term gives a source's probability of terms it does not have.
    """
    kept = frame["term"].notna().to_numpy()
    columns = np.full(len(frame), -1)
    codes, found = pd.factorize(frame["term"].to_numpy()[kept])
    columns[kept] = codes
    numbers = frame["number"].to_numpy()
    tile = frame["tile"].to_numpy()

    def dense(own_tile: int) -> tuple[np.ndarray, np.ndarray]:
        base = (tile == own_tile) & ~kept
        sources = np.sort(numbers[base])
        absent = np.zeros(len(sources), np.int64)
        absent[np.searchsorted(sources, numbers[base])] = frame["p"].to_numpy()[base]
        table = np.repeat(absent[:, None], len(found), axis=1)
        own = (tile == own_tile) & kept
        table[np.searchsorted(sources, numbers[own]), columns[own]] = frame["p"].to_numpy()[own]
        return sources, table

    low, high = int(frame["tile_a"].iloc[0]), int(frame["tile_b"].iloc[0])
    a_sources, a_table = dense(low)
    b_sources, b_table = (a_sources, a_table) if low == high else dense(high)
    parts = []
    for i, source in enumerate(a_sources):
        start = i + 1 if low == high else 0
        others = b_sources[start:]
        values = np.abs(b_table[start:] - a_table[i]).sum(axis=1)
        parts.append(np.stack([np.full(len(others), source), others, values, np.full(len(others), len(found))]))
    return pd.DataFrame(np.concatenate([np.zeros((4, 0), np.int64), *parts], axis=1).T, columns=["a", "b", "value", "seen"])


def audit_sources(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS,
    lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) that occurs.

    Terms are runs of ASCII letters and non-ASCII characters, with A-Z in lower case. A language
    keeps its terms of ``min_docs`` documents or more. A group's probability of a kept term is
    a whole number of billionths, smoothed by PRIOR. Part ``pair`` has a row per other source
    of the language: the summed differences of the two over all kept terms. Part ``term`` has
    the ``top`` kept terms that a group uses more than its language does, by the difference.
    Ranks go by falling value, then by the item's UTF-8 bytes. All numbers are whole and exact.

    Null texts, languages and sources are empty ones. Empty texts make a group occur. Repeated
    rows count again. Without kept terms all distances are 0. A very long text is split a piece at a
    time; its distinct terms are held at once. Other columns are ignored whatever their names; an
    empty table gives no rows.

    Documents are counted one by one in the tasks, where equal terms are summed up before they are
    shuffled, so a hot source sends a row per term and task. Sources are compared in
    tiles and blocks of terms, so no task sees all sources or all terms.
    """
    spark = docs.sparkSession
    on_workers(spark)
    empty = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    texts = internal(docs, lang=lang_col, source=source_col, text=text_col).select(*empty.values())
    # Groups by number in the order of language and source; a language is named by its first.
    groups, _ = number_rows(texts.select("lang", "source").distinct(), [F.col("lang"), F.col("source")], "number")
    groups = stage(groups)
    firsts = settle(groups.groupBy("lang").agg(F.min("number").alias("first")))
    groups = settle(attach(groups, firsts, ["lang"]))
    counts = stage(
        attach(texts, groups, ["lang", "source"]).select("number", F.col("first").alias("lang"), "text")
        .mapInArrow(tidy(_tokenize), "number long, lang long, term string, n long, docs long")
        .groupBy("number", "lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )

    # Kept terms of each language, how many they are, and what each group has of them.
    kept = stage(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_docs).drop("docs")
    )
    found = stage(join_side(counts.drop("docs"), kept, ["lang", "term"], "inner"))
    langs = settle(kept.groupBy(F.col("lang").alias("first")).agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")))
    sums = settle(found.groupBy("number").agg(F.sum("n").alias("total")))
    groups = settle(
        attach(attach(groups, langs, ["first"]), sums, ["number"]).fillna(0, ["terms", "lang_total", "total"])
        .withColumn("tile", F.floor(F.col("number") / TILE).cast("long"))
        .withColumn("absent", _share("0", "total", "terms"))
    )
    shares = stage(
        attach(found.drop("lang"), groups, ["number"])
        .withColumn("p", _share("n", "total", "terms"))
        .withColumn("q", _share("lang_n", "lang_total", "terms"))
        .select("first", "number", "tile", "terms", "term", "p", "q")
    )

    pairs = _pairs(shares, groups)
    above = shares.where("p > q").select("number", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("number").orderBy(F.col("value").desc(), "item")
    best = stage(above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
    return attach(ranked, groups.select("number", "lang", "source"), ["number"]).select("lang", "source", "part", "item", "value", "rank")


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``number, part, item, value``: the distance of every two sources of a language."""
    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("int")
    entries = shares.select(
        "first", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "tile", "number", "term", "p"
    )
    absent = groups.select(
        "first", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "tile", "number",
        F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"),
    )
    # Each tile meets every tile of its language, the lower one first.
    tiles = settle(groups.groupBy("first").agg(F.min("tile").alias("low"), F.max("tile").alias("high")))
    dealt = (
        attach(entries.unionByName(absent), tiles, ["first"])
        .withColumn("other", F.explode(F.sequence("low", "high")))
        .withColumn("tile_a", F.least("tile", "other")).withColumn("tile_b", F.greatest("tile", "other"))
        .select("first", "block", "tile_a", "tile_b", "tile", "number", "term", "p")
    )
    parts = dealt.groupBy("first", "block", "tile_a", "tile_b").applyInPandas(_distances, "a long, b long, value long, seen long")
    sums = stage(parts.groupBy("a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
    both = sums.unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "value", "seen"))
    own = groups.select(F.col("number").alias("a"), "terms", F.col("absent").alias("own_absent"))
    items = settle(groups.select(F.col("number").alias("b"), F.col("source").alias("item"), "absent"))
    # Terms that occur in neither tile.
    rest = (F.col("terms") - F.col("seen")) * F.abs(F.col("own_absent") - F.col("absent"))
    return attach(attach(both, settle(own), ["a"]), items, ["b"]).select(
        F.col("a").alias("number"), F.lit("pair").alias("part"), "item", (F.col("value") + rest).alias("value")
    )
