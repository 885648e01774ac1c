"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from guichet.llm.common import count_words, on_workers
from guichet.operators.ranks import number_rows
from guichet.operators.settle import join_side, settle, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
SHARDS = 64
SEED = 20240501
# A block has about this many words, or more once there would be over MOST_BLOCKS of them.
BLOCK_WORDS = 20_000
MOST_BLOCKS = 1 << 20
# Sources that one task splits at a time.
GROUP = 512


def split_tree(quotas: np.ndarray, sizes: np.ndarray, seed: Sequence[int]) -> np.ndarray:
    """Counts of every quota in every shard, drawn without replacement.

    The shards are halved again and again. At each node the left half gets a multivariate
    hypergeometric draw of the node's quotas, so each leaf has exactly its size and each
    quota is dealt out exactly.
    """
    counts = np.zeros((len(quotas), len(sizes)), np.int64)

    def deal(low: int, high: int, own: np.ndarray) -> None:
        if high - low == 1:
            counts[:, low] = own
            return
        middle = (low + high) // 2
        random = np.random.default_rng([*seed, low, high])
        left = random.multivariate_hypergeometric(own, int(sizes[low:middle].sum()), method="marginals")
        deal(low, middle, left)
        deal(middle, high, own - left)

    deal(0, len(sizes), np.asarray(quotas, np.int64))
    return counts


def _key(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source, rank, source_size, target`` of a table ``source, source_size``.

    Sources in code point order, null last, weigh ``weights`` in turn. They share ``share``
    times all words; a target stops at ``most`` times its source and the excess is shared
    again by weight. The driver sees one number a round.
    """
    numbered, _ = number_rows(sizes, [F.col("source").asc_nulls_last()], "rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = settle(numbered.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(most)))
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        given, weight = sources.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        if not weight:
            break
        higher = (budget - given) / weight
        if higher <= level:
            break
        level = higher
    target = F.least("cap", F.col("weight") * level)
    return sources.select("source", "rank", "source_size", target.alias("target"))


def _dealt(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``rank, ends``: per source, how many of its draws go to the shards up to each.

    ``quotas`` has ``rank, quota``. Groups of sources are split first, then the sources
    of each group by what the group got.
    """
    grouped = quotas.withColumn("group", F.floor(F.col("rank") / GROUP).cast("long"))

    def split_groups(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("group")
        total = int(frame["quota"].sum())
        sizes = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
        counts = split_tree(frame["quota"].to_numpy(), sizes, [seed, 0])
        return pd.DataFrame({"group": frame["group"].to_numpy(), "sizes": list(counts)})

    def split_sources(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        counts = split_tree(frame["quota"].to_numpy(), np.array(frame["sizes"].iloc[0]), [seed, 1, int(frame["group"].iloc[0])])
        return pd.DataFrame({"rank": frame["rank"].to_numpy(), "ends": list(counts.cumsum(axis=1))})

    totals = grouped.groupBy("group").agg(F.sum("quota").alias("quota"))
    sizes = totals.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(split_groups, "group long, sizes array<long>")
    return grouped.join(sizes, "group").groupBy("group").applyInPandas(split_sources, "rank long, ends array<long>")


def _fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each last block the documents that fill its room.

    They are taken in the order of their hash up to the first that does not fit, then the
    largest that still fit; at the end one is exchanged if that comes closer to the room.
    """

    def chosen(block: pd.DataFrame) -> pd.DataFrame:
        sizes, numbers, room = block["size"].to_numpy(), block["n"].to_numpy(), float(block["room"].iloc[0])
        take = np.where(sizes == 0, numbers, 0)
        order = np.flatnonzero(sizes > 0)
        upto = np.cumsum(sizes[order] * numbers[order])
        first = order[: int(np.searchsorted(upto, room, "right"))]
        rest = order[len(first):]
        take[first] = numbers[first]
        room -= float((sizes[first] * numbers[first]).sum())
        for i in rest[np.argsort(-sizes[rest], kind="stable")]:
            take[i] = min(numbers[i], int(room // sizes[i]))
            room -= take[i] * sizes[i]
        # One exchange of a taken document for another, or for none, that comes closest.
        taken = np.flatnonzero((sizes > 0) & (take > 0))
        left = np.flatnonzero((sizes > 0) & (take < numbers))
        if len(left):
            left = left[np.argsort(sizes[left], kind="stable")]
            given = np.append(sizes[taken], 0)
            place = np.searchsorted(sizes[left], given + room)
            near = np.stack([np.maximum(place - 1, 0), np.minimum(place, len(left) - 1)])
            misses = np.abs(room + given - sizes[left[near]])
            side, at = np.unravel_index(int(np.argmin(misses)), misses.shape)
            if misses[side, at] < room:
                take[left[near[side, at]]] += 1
                if at < len(taken):
                    take[taken[at]] -= 1
        return block.assign(take=take)[["rank", "block", "hash", "size", "take"]][take > 0]

    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = (frame["rank"] == frame["rank"].iloc[-1]) & (frame["block"] == frame["block"].iloc[-1])
        for _, block in frame[~last].groupby(["rank", "block"], sort=False):
            yield chosen(block)
        held = frame[last]
    if held is not None:
        yield chosen(held)


class Mix:
    """A mix of ``docs``: what each document contributes, and the mixed rows.

    Words are counted in ``text_col``; a null text has none. A null source is a source. Ids need
    not be distinct: rows are told apart by a hash of id, source and text, and rows that are
    equal in all three are interchangeable. Without words every target is 0. Other columns are
    carried along whatever their names.

    A source's rows fall into blocks by hash, so a large source has many. Whole rounds of all
    its blocks are taken first, then blocks in permuted order, then of one last block the
    documents that still fit; so taken words miss the target by less than a document. The
    draws of all sources are dealt to ``shards`` output shards by the splitting tree. All
    choices are keyed hashes, so reruns agree.
    A document is taken whole, ``rounds`` times or once more.
    """

    def __init__(
        self,
        docs: DataFrame,
        weights: Sequence[float] = WEIGHTS,
        share: float = SHARE,
        most: int = MOST,
        shards: int = SHARDS,
        seed: int = SEED,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
    ):
        on_workers(docs.sparkSession)
        self.docs, self.shards, self.seed = docs, shards, seed
        self.names = id_col, text_col, source_col
        narrow = stage(self._sized([id_col]))
        sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
        targets = source_targets(sizes, weights, share, most)
        total = targets.agg(F.sum("source_size")).first()[0] or 0
        words = max(BLOCK_WORDS, total / MOST_BLOCKS)
        self.targets = settle(
            targets.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / words), F.lit(1)).cast("long"))
            .withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
            .withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
            .withColumn("null_source", F.col("source").isNull())
            .withColumn("source", F.coalesce("source", F.lit("")))
        )
        rows = self._blocked(narrow)
        self.blocks = self._draws(rows)
        self.picks = self._picks(rows)
        self.narrow = narrow

    def _sized(self, carried: Sequence[str]) -> DataFrame:
        """``row`` with the carried columns, and what the mix needs to know of it."""
        id_col, text_col, source_col = (F.col(f"`{c}`") for c in self.names)
        return self.docs.select(
            F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
            source_col.cast("string").alias("source"),
            count_words(text_col).alias("size"),
            _key(self.seed, id_col, source_col, text_col).alias("hash"),
        )

    def _blocked(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("null_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
        return (
            join_side(rows, self.targets, ["source", "null_source"], "inner")
            .withColumn("block", F.pmod(_key(self.seed + 1, F.col("hash")), F.col("blocks")))
        )

    def _draws(self, rows: DataFrame) -> DataFrame:
        """Per block its draws (shard, and whether the last round takes only a part), and the
        room that is left in a block taken in part."""
        order = Window.partitionBy("rank").orderBy(_key(self.seed + 2, F.col("rank"), F.col("block")), "block")
        words = (
            rows.groupBy("rank", "block", "rounds", "rest")
            .agg(F.sum("size").alias("words"))
            .withColumn("place", F.row_number().over(order) - 1)
            .withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        )
        inside = (F.col("rest") > 0) | ((F.col("rounds") == 0) & (F.col("words") == 0))
        state = (
            F.when(inside & (F.col("upto") <= F.col("rest")), "whole")
            .when(inside & (F.col("upto") - F.col("words") < F.col("rest")), "part")
            .otherwise("none")
        )
        blocks = stage(
            words.withColumn("state", state).withColumn("room", F.col("rest") - F.col("upto") + F.col("words"))
        )
        again = (F.col("state") != "none").cast("int")
        quotas = blocks.groupBy("rank").agg(
            F.sum(F.col("rounds") + again).cast("long").alias("quota"), F.count(F.lit(1)).alias("size")
        )
        ends = settle(_dealt(quotas.select("rank", "quota"), self.shards, self.seed))
        sides = join_side(blocks, settle(quotas.select("rank", "size").join(ends, "rank")), ["rank"], "inner")
        draws = F.transform(
            F.sequence(F.lit(1), F.col("rounds") + again),
            lambda e: F.struct(
                e.alias("round"),
                F.size(F.filter("ends", lambda end: end <= (e - 1) * F.col("size") + F.col("place"))).alias("shard"),
                ((e > F.col("rounds")) & (F.col("state") == "part")).alias("part"),
            ),
        )
        none = F.array().cast("array<struct<round:int,shard:int,part:boolean>>")
        return settle(
            sides.select(
                "rank", "block", "state", "room",
                F.when(F.col("rounds") + again > 0, draws).otherwise(none).alias("draws"),
            )
        )

    def _picks(self, rows: DataFrame) -> DataFrame:
        parts = settle(self.blocks.where("state = 'part'").select("rank", "block", "room"))
        found = (
            join_side(rows.select("rank", "block", "hash", "size"), parts, ["rank", "block"], "inner")
            .groupBy("rank", "block", "hash", "size", "room")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        count = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return settle(
            found.repartition(count, "rank", "block")
            .sortWithinPartitions("rank", "block", "hash", "size")
            .mapInPandas(_fill, "rank long, block long, hash long, size long, take long")
        )

    def _planned(self, sized: DataFrame) -> DataFrame:
        """Every row with the draws that it is part of."""
        rows = join_side(self._blocked(sized), self.blocks.select("rank", "block", "state", "draws"), ["rank", "block"], "inner")
        settled = rows.where("state <> 'part'").drop("state")
        columns = settled.columns
        # Only rows of the blocks taken in part are told apart; equal ones are interchangeable.
        equal = Window.partitionBy("rank", "block", "hash", "size").orderBy("hash")
        partly = (
            rows.where("state = 'part'")
            .withColumn("number", F.row_number().over(equal))
            .join(self.picks, ["rank", "block", "hash", "size"], "left")
            .withColumn("draws", F.when(F.col("number") <= F.coalesce("take", F.lit(0)), F.col("draws")).otherwise(
                F.filter("draws", lambda d: ~d["part"])))
        )
        return settled.unionByName(partly.select(*columns))

    def report(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken, copies, block, shards`` of every row: ``shards``
        are the output shards that the splitting tree deals the draws of its block to, in the
        order of the rounds."""
        id_col = self.names[0]
        return self._planned(self.narrow).select(
            F.col("row")[id_col].alias(id_col),
            "size",
            "source_size",
            "target",
            (F.size("draws") * F.col("size")).cast("long").alias("taken"),
            F.size("draws").alias("copies"),
            "block",
            F.col("draws.shard").alias("shards"),
        )

    def shards_of_sources(self) -> DataFrame:
        """``rank, shard, draws``: how many block draws of each source the tree gives each shard."""
        return (
            self.blocks.select("rank", F.explode("draws").alias("draw"))
            .groupBy("rank", F.col("draw.shard").alias("shard"))
            .agg(F.count(F.lit(1)).alias("draws"))
        )

    def rows(self) -> DataFrame:
        """The mixed rows with the columns of ``docs``: a document taken twice is there twice.

        Rows come shard by shard and are shuffled inside a shard by a keyed hash.
        """
        drawn = self._planned(self._sized(self.docs.columns)).select("row", "hash", F.explode("draws").alias("draw"))
        return (
            drawn.repartitionByRange(self.shards, F.col("draw.shard"), _key(self.seed + 3, F.col("hash"), F.col("draw.round")))
            .sortWithinPartitions(F.col("draw.shard"), _key(self.seed + 3, F.col("hash"), F.col("draw.round")))
            .select("row.*")
        )
