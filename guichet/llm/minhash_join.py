"""Near duplicates by a multi-index Hamming join of MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from guichet.llm.common import internal, on_workers, small_batches, tidy
from guichet.llm.components import components
from guichet.llm.text_bytes import LOWER, groups, mix, windows, words
from guichet.operators.settle import is_small, join_side, settle, stage

SHINGLE = 5
# Two sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 75

# A signature has CHUNKS chunks of CHUNK symbols of 16 bits. Two signatures that differ in
# fewer than 2 * CHUNKS symbols have a chunk with at most one error (pigeonhole), so they
# share a key that leaves one symbol of a chunk out.
CHUNKS, CHUNK = 12, 4
SYMBOLS = CHUNKS * CHUNK
GUARANTEED = 2 * CHUNKS - 1
# Pairs that share a key are judged by all symbols, FINE further ones of 8 bits included. Up to
# this distance they are compared on full sets; a pair at the similarity threshold is beyond
# it about once in eighty millions, more rarely than it shares no key (once in ten millions).
FINE = 112
MOST_ERRORS = 72

# A sketch holds the upper halves of so many lowest hashes of a set, of most sets all.
SKETCH = 1024
# A pair may be so many standard deviations below the threshold by its sketches. One at the
# threshold is beyond that about once in 600 millions.
DEVIATIONS = 6

# Members of a key are compared in blocks of this size, and a centre's partners are split
# after so many.
BLOCK = 512
PARTNERS = 256


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text its distinct shingles as sorted hashes; a text of fewer words is one shingle."""
    for _, _, data, offsets in groups(texts):
        found = words(LOWER[data], offsets)
        windowed = windows(found.hashes, SHINGLE)
        for a, b in zip(found.first[:-1], found.first[1:]):
            if b - a >= SHINGLE:
                yield np.unique(windowed[a : b - SHINGLE + 1])
            else:
                yield windows(found.hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    n = SYMBOLS + FINE
    numbers = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:n, None] | np.uint64(1), numbers[n:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Symbols of the smallest shingle under each of SYMBOLS + FINE orders, in 16 bits each;
    the fine ones use 8 of them."""
    a, b = _coefficients()
    lowest = np.full(SYMBOLS + FINE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[None, at : at + 1024]
        lowest = np.minimum(lowest, (part * a + b).min(axis=1))
    symbols = (mix(lowest) >> np.uint64(48)).astype(np.uint16)
    symbols[SYMBOLS:] &= 255
    return symbols


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """All keys of signatures (rows): chunk number, left-out symbol and the other symbols."""
    chunks = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.int64)
    keys = np.empty((len(chunks), CHUNKS, CHUNK), np.int64)
    number = np.arange(CHUNKS, dtype=np.int64) * CHUNK
    for out in range(CHUNK):
        first, second, third = (chunks[:, :, j] for j in range(CHUNK) if j != out)
        keys[:, :, out] = (number + out) << 48 | first << 32 | second << 16 | third
    return keys.reshape(len(chunks), CHUNKS * CHUNK)


def _signed(docs: DataFrame) -> DataFrame:
    """``id, n_shingles, set_key, signature`` of ``id, text``, whatever the id is."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, signatures = [], [], []
            for shingles in shingle_sets(batch.column(1)):
                n.append(len(shingles))
                names.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                signatures.append(signature(shingles).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(signatures, pa.binary())],
                ["id", "n_shingles", "set_key", "signature"],
            )

    return docs.mapInArrow(tidy(sign), f"id {kind}, n_shingles long, set_key binary, signature binary")


def _as_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS + FINE)


def _keyed(classes: DataFrame) -> DataFrame:
    """``key, node``: every class under all its keys."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(_as_signatures(batch.column(1))[:, :SYMBOLS])
            nodes = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])

    return classes.select("node", "signature").mapInArrow(tidy(spread), "key long, node long")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold; sizes too different cannot."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large):
        return False
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[place] == small).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets of texts, next to all columns behind text and name."""
    for batch in batches:
        names = batch.column(1).to_pylist()
        kept, shingles = [], []
        for i, own in enumerate(shingle_sets(batch.column(0))):
            # An id may have rows of other texts.
            if xxhash.xxh3_128_digest(own.tobytes()) == names[i]:
                kept.append(i)
                shingles.append(own.tobytes())
        rest = batch.select(batch.schema.names[2:]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(shingles, pa.binary())], [*rest.schema.names, "shingles"])


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose full sets are similar enough.

    ``v`` is the base that its partners are held against. A base with many partners is sent
    out several times, each time with a part of them, so no task gets them all.
    """
    shares = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("shares"))
    split = settle(
        pairs.join(shares, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("shares")).cast("int").alias("share"))
    )
    roles = split.select(F.col("u").alias("node"), "v", "share", F.col("u").alias("partner")).unionByName(
        split.select("v", "share").distinct().select(F.col("v").alias("node"), "v", "share", F.lit(None).cast("long").alias("partner"))
    )
    roles = settle(roles.join(classes.select("node", "id", "set_key"), "node").drop("node"))
    texts = join_side(docs, roles, ["id"], "inner").select("text", "set_key", "v", "share", "partner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at = np.zeros(0, np.uint64), None
        for batch in batches:
            us, vs = [], []
            for v, share, partner, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(data, np.uint64)
                if partner is None:
                    base, at = own, (v, share)
                elif at == (v, share):
                    if _similar(own, base):
                        us.append(partner)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        texts.mapInArrow(tidy(_sets), "v long, share int, partner long, shingles binary")
        .repartition(parts, "v", "share")
        .sortWithinPartitions("v", "share", F.col("partner").asc_nulls_first())
        .mapInArrow(tidy(compare), "u long, v long")
    )


def _confirmed_in_blocks(docs: DataFrame, classes: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The same for pairs of which many share a text.

    The pairs that lead to a component are cut into blocks of ``u`` and ``v``, and a block gets
    each of its sets once, however many pairs it is in.
    """
    placed = stage(
        pairs.join(roots.select(F.col("node").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    )
    parts = placed.groupBy("root").agg(
        F.ceil(F.approx_count_distinct("u") / PARTNERS).cast("int").alias("us"),
        F.ceil(F.approx_count_distinct("v") / PARTNERS).cast("int").alias("vs"),
    )
    block = [F.pmod(F.xxhash64(c), F.greatest(F.col(f"{c}s"), F.lit(1))).cast("int").alias(f"{c}_block") for c in "uv"]
    placed = stage(placed.join(settle(parts), "root").select("u", "v", "root", *block))
    at = ["root", "u_block", "v_block"]
    none = F.lit(None).cast("array<long>").alias("partners")
    roles = placed.groupBy(*at, F.col("u").alias("node")).agg(F.collect_list("v").alias("partners")).unionByName(
        placed.select(*at, F.col("v").alias("node"), none).distinct()
    )
    roles = settle(roles.join(classes.select("node", "id", "set_key"), "node"))
    texts = join_side(docs, roles, ["id"], "inner").select("text", "set_key", *at, "node", "partners")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sets = None, {}
        for batch in batches:
            us, vs = [], []
            for root, i, j, node, partners, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, i, j) != here:
                    here, sets = (root, i, j), {}
                own = np.frombuffer(data, np.uint64)
                if partners is None:
                    sets[node] = own
                    continue
                for v in partners:
                    if _similar(own, sets[v]):
                        us.append(node)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        texts.mapInArrow(tidy(_sets), "root long, u_block int, v_block int, node long, partners array<long>, shingles binary")
        .repartition(count, *at)
        .sortWithinPartitions(*at, F.col("partners").isNotNull())
        .mapInArrow(tidy(compare), "u long, v long")
        .distinct()
    )


def _meetings(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks ``key, i, j`` of rows that share a key and are not all in one component so far.

    Within a key only members outside its largest component (side 0, ``few``) are held against
    all members (side 1). Both sides go in blocks of BLOCK rows.
    """
    placed = stage(
        members.select("key", "node")
        .join(roots, "node", "left")
        .select("key", "node", F.coalesce("root", "node").alias("root"))
    )
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    open_keys = settle(
        sizes.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"),
            F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("in_main"),
        )
        .where("roots > 1")
        .select(
            "key", "main",
            F.ceil((F.col("n") - F.col("in_main")) / BLOCK).cast("int").alias("few_blocks"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks"),
        )
    )
    rows = join_side(placed, open_keys, ["key"], "inner").withColumn("few", F.col("root") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rows.where("few").withColumn("i", own("few_blocks")).withColumn("j", every("all_blocks"))
    all_ = rows.withColumn("j", own("all_blocks")).withColumn("i", every("few_blocks"))
    sides = few.withColumn("side", F.lit(0)).unionByName(all_.withColumn("side", F.lit(1)))
    return sides.select("key", "i", "j", "side", "node", "root", "few").join(classes.select("node", "signature"), "node")


def _by_block(sides: DataFrame) -> DataFrame:
    parts = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ["key", "i", "j", "side"]
    first = [*at, "node", "root", "few", "signature"]
    return (
        sides.select(*first, *[c for c in sides.columns if c not in first])
        .repartition(parts, *at[:3])
        .sortWithinPartitions(*at, "node")
    )


def _first_common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of the first key that each signature of ``left`` shares with ``right``."""
    wrong = (left[:, :SYMBOLS] != right[:SYMBOLS]).reshape(-1, CHUNKS, CHUNK)
    chunk = (wrong.sum(axis=2) <= 1).argmax(axis=1)
    # Without an error any symbol may be left out, and argmax names the first.
    return chunk * CHUNK + wrong[np.arange(len(wrong)), chunk].argmax(axis=1)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple], tuple, list[tuple[int, int]]]]:
    """Per row of side 1 its block, the rows of side 0 there, itself, and what it meets:
    (index into side 0, errors).

    A pair under several common keys is met under the first of them only.
    """
    here, left, arrays = None, [], None
    for batch in batches:
        for key, i, j, side, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, i, j) != here:
                here, left, arrays = (key, i, j), [], None
            if side == 0:
                left.append(row)
                continue
            if not left:
                continue
            if arrays is None:
                arrays = np.array([x[1] for x in left]), _as_signatures(pa.array([x[3] for x in left], pa.binary()))
            own = np.frombuffer(row[3], np.uint16)
            errors = (arrays[1] != own).sum(axis=1)
            near = np.flatnonzero((errors <= MOST_ERRORS) & (arrays[0] != row[1]))
            near = near[_first_common(arrays[1][near], own) == key >> 48]
            yield here, left, row, [(int(y), int(errors[y])) for y in near]


def _in_batches(rows: Iterator[tuple], columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(columns.items()))
    while part := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), columns.values())], schema=schema)


def _nearest_crossing(meetings: DataFrame) -> DataFrame:
    """``u, v``: per member outside the largest component of its keys the nearest of another."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, int]]:
            at, best = None, {}
            for here, left, row, met in _met(batches):
                if here != at:
                    yield from ((u, v, e) for u, (e, v) in best.items())
                    at, best = here, {}
                for y, errors in met:
                    u = left[y][0]
                    best[u] = min(best.get(u, (errors, row[0])), (errors, row[0]))
            yield from ((u, v, e) for u, (e, v) in best.items())

        yield from _in_batches(rows(), {"u": pa.int64(), "v": pa.int64(), "errors": pa.int32()})

    found = _by_block(meetings).mapInArrow(tidy(compare), "u long, v long, errors int")
    return found.groupBy("u").agg(F.min_by("v", F.struct("errors", "v")).alias("v"))


def _all_crossing(docs: DataFrame, classes: DataFrame, meetings: DataFrame) -> DataFrame:
    """``u, v``: all pairs in different components whose sketches allow the threshold.

    Near the threshold the signatures of a group let many pairs through that are no links. So
    the first step gives out rows and not pairs: those that meet any other in their block.
    They come back with their sketches and are judged in the same blocks.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, marked = None, set()
            for here, left, row, met in _met(batches):
                if here != at:
                    at, marked = here, set()
                met = [y for y, _ in met if _once(left[y], row)]
                yield from ((*here, 0, *left[y][:3]) for y in met if y not in marked)
                marked.update(met)
                if met:
                    yield (*here, 1, *row[:3])

        long, whole = pa.int64(), pa.int32()
        yield from _in_batches(rows(), {"key": long, "i": whole, "j": whole, "side": whole, "node": long, "root": long, "few": pa.bool_()})

    marked = stage(
        _by_block(meetings).mapInArrow(tidy(mark), "key long, i int, j int, side int, node long, root long, few boolean")
    )
    nodes = settle(marked.select("node").distinct().join(classes.select("node", "id", "set_key", "signature"), "node"))
    texts = join_side(docs, nodes, ["id"], "inner").select("text", "set_key", "node", "signature")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sets(batches):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            sketches = [(x[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(x) for x in sets], pa.int64()), pa.array(sketches, pa.binary())],
                ["node", "signature", "n", "sketch"],
            )

    sketches = stage(texts.mapInArrow(tidy(sketch), "node long, signature binary, n long, sketch binary").dropDuplicates(["node"]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int]]:
            for _, left, row, met in _met(batches):
                for y, _ in met:
                    if _once(left[y], row) and _may_link(left[y][4:], row[4:]):
                        yield left[y][0], row[0]

        yield from _in_batches(rows(), {"u": pa.int64(), "v": pa.int64()})

    return _by_block(marked.join(sketches, "node")).mapInArrow(tidy(judge), "u long, v long")


def _once(u: list, v: list) -> bool:
    """Two rows that are both outside the largest component meet twice."""
    return not v[2] or u[0] > v[0]


def _may_link(a: list, b: list) -> bool:
    """Whether sets of which ``n, sketch`` is known can reach the threshold.

    Whole sets are judged as they are. Of longer ones the lowest hashes of the union are a
    sample, in which a pair may fall DEVIATIONS short.
    """
    if 100 * min(a[0], b[0]) < PERCENT * max(a[0], b[0]):
        return False
    own, other = np.frombuffer(a[1], np.uint32), np.frombuffer(b[1], np.uint32)
    if max(a[0], b[0]) <= SKETCH:
        return _similar(own, other)
    union = np.union1d(own, other)[:SKETCH]
    common = int((np.isin(union, own) & np.isin(union, other)).sum())
    share = PERCENT / 100
    return common >= share * len(union) - DEVIATIONS * (len(union) * share * (1 - share)) ** 0.5


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, n_shingles, set_key`` of every row, and ``set_key, component`` of the sets that are
    in a component of several rows or under a lower id."""
    signed = stage(_signed(docs))
    classes = stage(
        signed.where("n_shingles > 0 AND id IS NOT NULL")
        .groupBy("set_key", "signature")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), "id", "copies", "set_key", "signature")
    )

    keyed = _keyed(classes)
    shared = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = stage(join_side(keyed, shared, ["key"], "inner"))
    # The member that meets others most often is the centre of its keys: the text that copies
    # were made from is nearer to each of them than they are to each other.
    meetings = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("meetings"))
    centres = members.join(meetings, "node").groupBy("key").agg(F.max_by("node", "meetings").alias("centre"))
    nearest = (
        members.join(centres, "key")
        .where("node <> centre")
        .groupBy("node", "centre")
        .agg(F.count(F.lit(1)).alias("common"))
        .groupBy("node")
        .agg(F.max_by("centre", "common").alias("centre"))
    )
    links = stage(_confirmed(docs, classes, settle(nearest.select(F.col("node").alias("u"), F.col("centre").alias("v")))))
    roots = settle(components(links))
    # Then the nearest of another component, then all that are left.
    for one_each in (True, False):
        meetings = _meetings(members, classes, roots)
        crossing = settle(_nearest_crossing(meetings) if one_each else _all_crossing(docs, classes, meetings))
        if crossing.isEmpty():
            break
        confirmed = _confirmed(docs, classes, crossing) if one_each else _confirmed_in_blocks(docs, classes, crossing, roots)
        links = stage(links.unionByName(confirmed))
        roots = settle(components(links))

    named = classes.select("node", "id", "set_key", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("classes"))
    # A class of one row that is a component alone needs no entry.
    by_set = settle(
        named.join(lowest, "root").where("copies > 1 OR classes > 1").select("set_key", "component", "root")
    )
    return signed.select("id", "n_shingles", "set_key"), by_set


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, set_key, component, root, kept`` of every row; without a root a row is the
    only one of its component, or has copies of its set only."""
    on_workers(docs.sparkSession)
    docs = internal(docs, id=id_col, text=text_col)
    with small_batches(docs.sparkSession):
        signed, by_set = _grouped(docs)
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return join_side(signed, by_set, ["set_key"], "left").select(
        "id", "n_shingles", "set_key", component.alias("component"), "root",
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Rows with equal shingle sets form a class, and one signature stands for it. Classes that
    share a signature key are candidates. First each class is held against one central class
    of its keys, which unites most groups; after that only members of a key that are still in
    different components are compared, nearest first. So a group of n copies costs about n
    comparisons. Links are confirmed on full sets of 64-bit shingle hashes.

    Signatures that differ in at most GUARANTEED symbols share a key. A pair of exactly the least
    similarity shares none about once in ten millions, and is turned down by its finer signature or
    its sketch about once in seventy millions; the more similar, the rarer by far. Nothing else
    separates a pair whose full sets reach the threshold.

    ``component_id`` is the lowest id reachable, ``kept`` whether a row has it. A null, empty or
    blank text has no shingles and is linked with nothing. A row without an id cannot be named,
    so it is linked with nothing, has a null ``component_id`` and is kept. Repeated rows are in
    one component; each gives a row. Rows of one id with different texts are linked like rows
    of different ids. Ids may be of any type that has an order. Other columns are ignored whatever
    their names.
    """
    return _judged(docs, id_col, text_col).select(
        F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), "kept"
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per group of near duplicates.

    The row with the lowest id stays; of rows of one id and group, repeated ones too, that with the lowest
    text. An id may have texts of several groups: each is judged on its own. Rows without an
    id stay, and so do all texts without shingles, but for repeats of their id.
    """
    found = stage(_judged(docs, id_col, text_col).where("id IS NOT NULL").select("id", "set_key", "root", "kept"))
    ids = found.groupBy(F.col("id").alias(id_col)).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kept"), 1)).alias("n_kept")
    )
    dropped = settle(ids.where("n_kept = 0").select(id_col))
    rest = join_side(docs, dropped, [id_col], "left_anti")
    repeated = settle(ids.where("n > 1 AND n_kept > 0").select(id_col))
    if repeated.isEmpty():
        return rest.select(docs.columns)
    once = join_side(rest, repeated, [id_col], "left_anti")
    # Rows that share an id are told apart by their sets.
    row = F.struct(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = join_side(rest, repeated, [id_col], "left_semi").select(row.alias("id"), F.col(f"`{text_col}`").alias("text"))
    named = _signed(rows.distinct()).select(F.col("id.row").alias("row"), F.col("id.text").alias("text"), "set_key", "n_shingles")
    groups = found.where("kept").select("id", "set_key", "root").distinct()
    again = (
        named.withColumn("id", F.col("row")[id_col]).join(groups, ["id", "set_key"])
        .groupBy("id", "root", F.when(F.col("root").isNull(), F.col("set_key")).alias("alone"), F.when(F.col("n_shingles") == 0, F.col("text")).alias("blank"))
        .agg(F.min(F.struct("text", "row")).alias("first"))
    )
    return once.select(docs.columns).unionByName(again.select("first.row.*").select(docs.columns))
