"""The trie of conversation prefixes, by vertical bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from guichet.llm.common import internal, on_workers
from guichet.operators.ranks import number_rows
from guichet.operators.settle import attach, settle, stage

# Conversations of a shard, and turns of a conversation that a shard takes at a time.
SHARD = 512
SEGMENT = 512
# Every conversation takes its first turns from the first of its block of FAMILY ids, as many as
# a checksum of its id modulo SHARED says.
FAMILY = 5
SHARED = 9
SEED = 20240717
# Characters of role and text that order turns of the same number, before their hashes.
TIE_CHARS = 32

KEY = ["high", "low"]


def _hashes(*columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(SEED + lane), *columns).alias(name) for lane, name in enumerate(KEY)]


def rebuild(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``conv_id, number, length`` per conversation; ``conv_id, pos, high, low, bytes`` per rebuilt turn).

    A conversation c of which h = crc32(c) % SHARED begins with the first h turns of conversation
    c - c % FAMILY and goes on with its own turns after its first h. ``pos`` counts from 1,
    ``number`` conversations by their id from 0. ``high`` and ``low`` name a turn by its role and
    text, ``bytes`` are those of the text.
    """
    empty = {"role": F.coalesce(F.col("role").cast("string"), F.lit("")), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))}
    named = (
        internal(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
        .where("conv_id is not null").withColumns(empty)
        .select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn",
            F.substring("role", 1, TIE_CHARS).alias("role"), F.substring("text", 1, TIE_CHARS).alias("text"),
            *_hashes(F.col("role"), F.col("text")), F.octet_length("text").cast("long").alias("bytes"),
        )
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *[F.col(c) for c in ("role", "text", *KEY)]]
    ordered, _ = number_rows(named, order, "place")

    own = ordered.groupBy("conv_id").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("own"))
    numbered, _ = number_rows(own, [F.col("conv_id")], "number")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    numbered = stage(
        numbered.withColumn("base", base).withColumn("taken", F.crc32(F.col("conv_id").cast("string")) % SHARED)
    )
    base_sizes = numbered.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = stage(
        numbered.join(base_sizes, "base", "left")
        .withColumn("prefix", F.least("taken", F.coalesce("base_own", F.lit(0))))
        .withColumn("length", F.col("prefix") + F.greatest(F.col("own") - F.col("taken"), F.lit(0)))
    )

    placed = (
        attach(ordered.drop("turn", "role", "text"), convs.select("conv_id", "start", "taken", "prefix"), ["conv_id"])
        .withColumn("pos", F.col("place") - F.col("start") + 1)
    )
    suffixes = placed.where("pos > taken").select(
        "conv_id", (F.col("prefix") + F.col("pos") - F.col("taken")).alias("pos"), *KEY, "bytes"
    )
    # At most SHARED - 1 turns of a base meet the conversations of its block.
    firsts = placed.where(F.col("pos") < SHARED).select(F.col("conv_id").alias("base"), "pos", *KEY, "bytes")
    prefixes = (
        convs.where("prefix > 0").select("conv_id", "base", "prefix").join(firsts, "base")
        .where("pos <= prefix").select("conv_id", "pos", *KEY, "bytes")
    )
    return convs.select("conv_id", "number", "length"), prefixes.unionByName(suffixes)


def _paths(convs: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """One row per conversation and segment of its turns: ``conv_id, shard, segment, before,
    entry_high, entry_low, last, high, low, bytes``. There are ``before`` turns before the segment, and the
    entry names that prefix; the last segment of a conversation is the one it ends in, which may
    be without turns.

    A prefix is named by the exclusive or of hashes of its (position, turn) pairs.
    """
    segment = F.floor((F.col("pos") - 1) / SEGMENT).cast("long")
    pieces = (
        rebuilt.select("conv_id", segment.alias("segment"), "pos", *_hashes(F.col("pos"), *[F.col(c) for c in KEY]), "bytes")
        .groupBy("conv_id", "segment")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", *KEY, "bytes"))).alias("turns"),
            *[F.bit_xor(c).alias(f"own_{c}") for c in KEY],
        )
    )
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    with_entry = stage(pieces).withColumns(
        {f"entry_{c}": F.coalesce(F.bit_xor(f"own_{c}").over(before), F.lit(0).cast("long")) for c in KEY}
    )
    all_ = convs.join(with_entry, "conv_id", "left")
    return stage(
        all_.select(
            "conv_id", F.floor(F.col("number") / SHARD).cast("long").alias("shard"),
            F.coalesce("segment", F.lit(0)).cast("long").alias("segment"),
            (F.coalesce("segment", F.lit(0)) * SEGMENT).cast("long").alias("before"),
            *[F.coalesce(f"entry_{c}", F.lit(0)).cast("long").alias(f"entry_{c}") for c in KEY],
            (F.coalesce("segment", F.lit(0)) == F.floor((F.greatest("length", F.lit(1)) - 1) / SEGMENT)).alias("last"),
            *[F.coalesce(F.col(f"turns.{c}"), F.array().cast("array<bigint>")).alias(c) for c in (*KEY, "bytes")],
        )
    )


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _walk(frame: pd.DataFrame) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The nodes of a shard's segment: (members, depth in the segment, key and parent's key).

    Conversations are bits in the order of their ids. The index has a bitmap per (position,
    turn); a node's children are the intersections of its bitmap with those of the next position,
    taken depth first. Depth 0 are the prefixes before the segment.
    """
    highs = [a.tolist() for a in frame["high"]]
    lows = [a.tolist() for a in frame["low"]]
    index: dict[tuple[int, int, int], int] = {}
    longer: dict[int, int] = {}
    entries: dict[tuple[int, int], int] = {}
    for i, entry in enumerate(zip(frame["entry_high"].tolist(), frame["entry_low"].tolist())):
        bit = 1 << i
        entries[entry] = entries.get(entry, 0) | bit
        for place, turn in enumerate(zip(highs[i], lows[i])):
            index[(place, *turn)] = index.get((place, *turn), 0) | bit
            longer[place] = longer.get(place, 0) | bit
    agenda = [(bits, 0, high, low) for (high, low), bits in entries.items()]
    for bits, _, high, low in agenda:
        yield bits, 0, high, low, 0, 0
    while agenda:
        bits, depth, high, low = agenda.pop()
        rest = bits & longer.get(depth, 0)
        while rest:
            first = (rest & -rest).bit_length() - 1
            turn = highs[first][depth], lows[first][depth]
            child = bits & index[(depth, *turn)]
            rest &= ~child
            key = high ^ turn[0], low ^ turn[1]
            yield child, depth + 1, *key, high, low
            agenda.append((child, depth + 1, *key))


def _by_id(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values("conv_id", ignore_index=True)


def _local_nodes(frame: pd.DataFrame) -> pd.DataFrame:
    frame = _by_id(frame)
    ids, bytes_ = frame["conv_id"].tolist(), frame["bytes"].tolist()
    shard, before = int(frame["shard"].iloc[0]), int(frame["before"].iloc[0])
    sizes = [len(b) for b in bytes_]
    ends_at: dict[int, int] = {}
    for i, (size, last) in enumerate(zip(sizes, frame["last"])):
        if last:
            ends_at[size] = ends_at.get(size, 0) | 1 << i
    rows = []
    for bits, depth, high, low, parent_high, parent_low in _walk(frame):
        if depth == 0 and before:
            continue  # the segment before has it
        first = (bits & -bits).bit_length() - 1
        ends = bits & ends_at.get(depth, 0)
        rows.append(
            (
                before + depth, high, low, parent_high, parent_low, shard, ids[first], bits.bit_count(),
                int(bytes_[first][depth - 1]) if depth else 0,
                ",".join(str(ids[i]) for i in _members(ends)) if ends else None,
            )
        )
    return pd.DataFrame(rows, columns=["depth", "high", "low", "parent_high", "parent_low", "shard", "first", "n", "bytes", "ends"])


def _local_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Per node the summed weights of the members."""
    frame = _by_id(frame)
    before = int(frame["before"].iloc[0])
    weights = list(zip(frame["leaves"].tolist(), frame["saved"].tolist()))
    rows = []
    for bits, depth, high, low, _, _ in _walk(frame):
        if depth == 0 and before:
            continue
        own = [weights[i] for i in _members(bits)]
        rows.append((before + depth, high, low, sum(w[0] for w in own), sum(w[1] for w in own)))
    return pd.DataFrame(rows, columns=["depth", "high", "low", "leaves", "saved"])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the end lists of each node; rows come node by node, shard by shard."""
    own, digest = None, hashlib.sha256()
    for frame in frames:
        rows = []
        for node, ends in zip(zip(*[frame[c].tolist() for c in ("depth", *KEY)]), frame["ends"]):
            if node == own:
                digest.update(b"," + ends.encode())
                continue
            if own is not None:
                rows.append((*own, digest.hexdigest()))
            own, digest = node, hashlib.sha256(ends.encode())
        yield pd.DataFrame(rows, columns=["depth", *KEY, "ends_sha256"])
    if own is not None:
        yield pd.DataFrame([(*own, digest.hexdigest())], columns=["depth", *KEY, "ends_sha256"])


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (``rebuild``), the empty one included:
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conv_id`` is the smallest member, that is conversation that begins with the prefix. A node's
    ``saved_tokens`` are summed over its subtree: members but one times the bytes of the last text.
    ``ends_sha256`` hashes the ids of the members that end there, ascending and joined by commas.

    Shards are runs of conversations in the order of their ids. In each one a bitmap per
    (position, turn) is intersected depth first, which gives the shard's nodes with their counts
    and end lists; nodes of different shards that stand for the same prefix are then summed up, so a
    prefix that all conversations share costs a row per shard. Sums over subtrees need no
    walk over the levels: every node's value goes to its smallest member, and a second walk adds
    the members' values up. A long conversation is taken a segment of turns at a time.

    Turns without a conversation are left out. A null turn number comes first; turns of the same
    number are ordered by role, the begin of the text and a hash. Null roles and texts are empty.
    Repeated rows are turns of their own. A very long text takes part by a hash and its length.
    Ids are whole numbers. Other columns are ignored whatever their names; without
    conversations there is no row. Prefixes are told apart by 128-bit hashes.
    """
    spark = turns.sparkSession
    on_workers(spark)
    convs, rebuilt = rebuild(turns, conv_col, turn_col, role_col, text_col)
    paths = _paths(convs, rebuilt)
    node = ["depth", *KEY]

    local = stage(
        paths.groupBy("shard", "segment").applyInPandas(
            _local_nodes,
            "depth long, high long, low long, parent_high long, parent_low long, shard long, first long, n long, bytes long, ends string",
        )
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digests = stage(
        local.where("ends is not null").select(*node, "shard", "ends")
        .repartition(parts, *node).sortWithinPartitions(*node, "shard")
        .mapInPandas(_digests, "depth long, high long, low long, ends_sha256 string")
    )
    nodes = stage(
        local.groupBy(*node).agg(
            F.min("parent_high").alias("parent_high"), F.min("parent_low").alias("parent_low"),
            F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"),
        )
    )
    children = (
        nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_high").alias("high"), F.col("parent_low").alias("low"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    nodes = stage(
        nodes.join(children, node, "left").fillna(0, ["n_children"])
        .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
        .withColumn("own_saved", (F.col("n_convs") - 1) * F.col("bytes"))
    )

    # What a conversation has in the nodes it is the smallest member of, and above each of them.
    segment = F.floor(F.col("depth") / SEGMENT).alias("segment")
    totals = stage(nodes.groupBy("conv_id", segment).agg(F.sum("leaf").alias("leaves"), F.sum("own_saved").alias("saved")))
    upper = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    above_segments = totals.select(
        "conv_id", "segment", *[F.coalesce(F.sum(c).over(upper), F.lit(0)).alias(f"{c}_above") for c in ("leaves", "saved")]
    )
    inside = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = nodes.withColumn("segment", segment).join(above_segments, ["conv_id", "segment"]).select(
        *nodes.columns,
        (F.col("leaves_above") + F.coalesce(F.sum("leaf").over(inside), F.lit(0))).alias("leaves_above"),
        (F.col("saved_above") + F.coalesce(F.sum("own_saved").over(inside), F.lit(0))).alias("saved_above"),
    )
    weights = stage(totals.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    sums = (
        attach(paths.select("conv_id", "shard", "segment", "before", "entry_high", "entry_low", *KEY), weights, ["conv_id"])
        .fillna(0, ["leaves", "saved"])
        .groupBy("shard", "segment").applyInPandas(_local_sums, "depth long, high long, low long, leaves long, saved long")
        .groupBy(*node).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    summed = above.join(sums, node).join(digests, node, "left")

    # The parent has the same smallest member, but for the first node of a member's own.
    parents = stage(
        nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("high").alias("parent_high"), F.col("low").alias("parent_low"), F.col("conv_id").alias("parent_conv_id"))
    )
    result = attach(stage(summed), parents, ["depth", "parent_high", "parent_low"])
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") - F.col("leaves_above")).alias("n_leaves"),
        (F.col("saved") - F.col("saved_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
