"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from guichet.llm.common import internal, on_workers, tidy
from guichet.operators.settle import is_small, join_side, settle, stage

# Rows of a shard: what one task holds and builds a graph of.
SHARD_ROWS = 8192
DEGREE = 32
# Candidates kept while a graph is built, and while it is searched.
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
# Distances are relaxed by this factor before an edge is pruned as covered by another.
ALPHA = 1.2
# Nodes that are inserted together, and queries that walk a graph together.
BATCH = 512
# Rows that a search starts from, spread at random so that it lands in dense groups as well
# as outside of them, and random edges of every row that lead out of its group.
STARTS = 48
FAR_EDGES = 4


def _distances(points: np.ndarray, norms: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances, up to the query's own norm, of rows ``ids`` (n x m) to n queries."""
    return norms[ids] - 2 * np.einsum("nmd,nd->nm", points[ids], queries, optimize=False)


@dataclass
class Graph:
    points: np.ndarray
    edges: np.ndarray  # n x degree, -1 where there is none
    starts: np.ndarray

    def __post_init__(self):
        self.norms = np.einsum("nd,nd->n", self.points, self.points)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries in step: each keeps its ``width`` nearest rows so far
        and expands the nearest one not yet expanded, until all of them are. -1 fills up."""
        n, rows = len(queries), np.arange(len(queries))
        width = min(width, len(self.points))
        ids = np.full((n, width), -1, np.int64)
        near = np.full((n, width), np.inf, np.float32)
        done = np.zeros((n, width), bool)
        seen = np.zeros((n, len(self.points)), bool)
        starts = self.starts[:width]
        ids[:, : len(starts)] = starts
        near[:, : len(starts)] = self.norms[starts] - 2 * queries @ self.points[starts].T
        seen[:, starts] = True
        active = rows
        while len(active):
            open_ = np.where(done[active] | (ids[active] < 0), np.inf, near[active])
            best = open_.argmin(axis=1)
            going = np.isfinite(open_[np.arange(len(active)), best])
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            ahead = self.edges[ids[active, best]]
            safe = np.maximum(ahead, 0)
            fresh = (ahead >= 0) & ~seen[active[:, None], safe]
            place = np.where(fresh, safe, starts[0])
            seen[active[:, None], place] = True
            far = _distances(self.points, self.norms, place, queries[active])
            far[~fresh] = np.inf
            all_ids = np.concatenate([ids[active], np.where(fresh, ahead, -1)], axis=1)
            all_near = np.concatenate([near[active], far], axis=1)
            all_done = np.concatenate([done[active], np.zeros(fresh.shape, bool)], axis=1)
            keep = np.argpartition(all_near, width - 1, axis=1)[:, :width]
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            near[active] = np.take_along_axis(all_near, keep, 1)
            done[active] = np.take_along_axis(all_done, keep, 1)
        order = np.argsort(near, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def robust_prune(points: np.ndarray, own: np.ndarray, pools: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of the rows ``own`` out of their candidate pools (-1 for none).

    The nearest candidate becomes an edge and covers every candidate that is, even relaxed
    by ``alpha``, nearer to it than to the row; then the nearest of the rest, and so on.
    """
    n, m = pools.shape
    safe = np.maximum(pools, 0)
    rows = points[safe]
    gap = ((rows - points[own][:, None, :]) ** 2).sum(axis=2)
    gap[(pools < 0) | (pools == own[:, None])] = np.inf
    # Repeated candidates count once.
    order = np.argsort(gap, axis=1, kind="stable")
    pools, gap = np.take_along_axis(pools, order, 1), np.take_along_axis(gap, order, 1)
    rows = np.take_along_axis(rows, order[:, :, None], 1)
    norms = (rows**2).sum(axis=2)
    between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * rows @ rows.transpose(0, 2, 1), 0)
    relaxed = alpha * alpha
    edges = np.full((n, degree), -1, np.int64)
    left = np.isfinite(gap)
    at = np.arange(n)
    for e in range(min(degree, m)):
        best = np.where(left, gap, np.inf).argmin(axis=1)
        some = left[at, best]
        if not some.any():
            break
        edges[some, e] = pools[some, best[some]]
        covered = relaxed * between[at, best] <= gap
        left &= ~(covered & some[:, None])
        left[at, best] = False
    return edges


def _with_back_edges(graph: Graph, own: np.ndarray, degree: int, alpha: float) -> None:
    """Each new edge also back; rows with too many are pruned again."""
    sources = np.repeat(own, degree)
    targets = graph.edges[own].ravel()
    ok = targets >= 0
    order = np.argsort(targets[ok], kind="stable")
    targets, sources = targets[ok][order], sources[ok][order]
    unique, first, counts = np.unique(targets, return_index=True, return_counts=True)
    place = np.arange(len(targets)) - np.repeat(first, counts)
    for low in range(0, len(unique), BATCH):
        block = unique[low : low + BATCH]
        begin, end = first[low], first[low] + counts[low : low + BATCH].sum()
        more = np.full((len(block), int(counts[low : low + BATCH].max())), -1, np.int64)
        more[np.searchsorted(block, targets[begin:end]), place[begin:end]] = sources[begin:end]
        old = graph.edges[block]
        more[(more[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        pool = np.concatenate([old, more], axis=1)
        total = (pool >= 0).sum(axis=1)
        fits = total <= degree
        packed = np.take_along_axis(pool, np.argsort(pool < 0, axis=1, kind="stable"), 1)[:, :degree]
        graph.edges[block[fits]] = packed[fits]
        if (~fits).any():
            # Wide pools are pruned in parts, so memory stays bounded.
            wide = pool[~fits]
            rows = block[~fits]
            pruned = wide[:, : 4 * degree]
            kept = robust_prune(graph.points, rows, pruned, degree, alpha)
            for at in range(4 * degree, wide.shape[1], 3 * degree):
                kept = robust_prune(graph.points, rows, np.concatenate([kept, wide[:, at : at + 3 * degree]], axis=1), degree, alpha)
            graph.edges[rows] = kept


def build_graph(points: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH, alpha: float = ALPHA, seed: int = 3) -> Graph:
    """A graph that greedy search can walk from its starts to the neighbourhood of any row.

    Rows are inserted in random order, in batches that double up to BATCH: a search of the
    graph so far proposes neighbours, robust pruning keeps diverse ones, and back edges are
    added. A second round goes over all rows with the relaxed pruning. At the end each row
    gets a few random edges.
    """
    points = np.ascontiguousarray(points, np.float32)
    n = len(points)
    random = np.random.default_rng(seed)
    order = random.permutation(n)
    graph = Graph(points, np.full((n, degree), -1, np.int64), order[: min(STARTS, n)])
    for relaxed in (1.0, alpha):
        at = 1 if relaxed == 1.0 else 0
        while at < n:
            size = min(BATCH, max(at, 1) if relaxed == 1.0 else BATCH, n - at)
            own = order[at : at + size]
            found, _ = graph.search(points[own], width)
            if relaxed != 1.0:
                found = np.concatenate([found, graph.edges[own]], axis=1)
                # An edge that was also found counts once.
                ordered = np.sort(found, axis=1)
                ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
                found = ordered
            graph.edges[own] = robust_prune(points, own, found, degree, relaxed)
            _with_back_edges(graph, own, degree, relaxed)
            at += size
    edges = np.sort(np.concatenate([graph.edges, random.integers(0, n, (n, FAR_EDGES))], axis=1), axis=1)
    edges[:, 1:][edges[:, 1:] == edges[:, :-1]] = -1
    graph.edges = edges
    return graph


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, vector, dim`` of the rows that take part: not null, not zero, all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return (
        internal(vectors, id=id_col, vector=vector_col)
        .where("id IS NOT NULL AND vector IS NOT NULL")
        .withColumn("vector", F.col("vector").cast("array<float>"))
        .where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
        .withColumn("dim", F.size("vector"))
    )


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``dim, shard, node, is_start, extra, id, vector, edges``: a graph per shard, every row in one.

    ``rows`` has ``id, vector, dim`` and one row per distinct vector. Rows fall into shards by
    the hash of their id, so shards are of nearly equal size. For inner products vectors are
    lengthened by a component that gives all the same norm, after which the nearest by
    distance are those of the largest inner product.
    """
    on_workers(rows.sparkSession)
    sizes = settle(
        rows.groupBy("dim").agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / shard_rows), F.lit(1)).cast("int").alias("shards"),
            F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("longest"),
        )
    )
    dealt = join_side(rows, sizes, ["dim"], "inner").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        vectors = np.stack(frame["vector"].to_numpy()).astype(np.float32)
        squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        extra = np.sqrt(np.maximum(frame["longest"].iloc[0] - squares, 0.0))
        graph = build_graph(np.column_stack([vectors, extra]))
        return pd.DataFrame(
            {
                "dim": frame["dim"].to_numpy(), "shard": frame["shard"].to_numpy(),
                "node": np.arange(len(frame)), "is_start": np.isin(np.arange(len(frame)), graph.starts), "extra": extra,
                "id": frame["id"].to_numpy(), "vector": frame["vector"].to_numpy(), "edges": list(graph.edges),
            }
        )

    return dealt.groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard int, node int, is_start boolean, extra double, id long, vector array<float>, edges array<int>"
    )


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """``query_id, id, score``: the ``k`` best rows that beam search finds in each shard.

    ``queries`` has ``id, vector, dim`` and goes to all shards of its dimension. A task holds one
    shard's graph and streams the queries past it in blocks.
    """
    on_workers(index.sparkSession)
    shards = settle(index.select("dim", "shard").distinct())
    sent = join_side(queries, shards, ["dim"], "inner")
    rows = index.select("dim", "shard", F.lit(0).alias("side"), "node", "is_start", "extra", "id", "vector", "edges").unionByName(
        sent.select(
            "dim", "shard", F.lit(1).alias("side"), F.lit(0).alias("node"), F.lit(False).alias("is_start"), F.lit(0.0).alias("extra"),
            "id", "vector", F.lit(None).cast("array<int>").alias("edges"),
        )
    )

    def matrix(column: pa.Array, width_: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width_)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, graph, ids = None, [], None, None

        def opened(parts):
            table = pa.Table.from_batches(parts)
            dim = table.column("dim")[0].as_py()
            vectors = matrix(table.column("vector").combine_chunks(), dim)
            node = table.column("node").to_numpy()
            edges = matrix(table.column("edges").combine_chunks(), len(table.column("edges")[0]))
            order = np.argsort(node)
            points = np.column_stack([vectors, table.column("extra").to_numpy()]).astype(np.float32)[order]
            return Graph(points, edges[order].astype(np.int64), np.flatnonzero(table.column("is_start").to_numpy()[order])), table.column("id").to_numpy()[order]

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(keys)]):
                if low == high:
                    continue
                dim, shard, side = keys[low]
                part = batch.slice(low, high - low)
                if (dim, shard) != at:
                    at, parts, graph = (dim, shard), [], None
                if side == 0:
                    parts.append(part)
                    continue
                if graph is None:
                    graph, ids = opened(parts)
                    parts = []
                for begin in range(0, len(part), BATCH):
                    block = part.slice(begin, BATCH)
                    vectors = matrix(block.column(7), dim)
                    query_ids = block.column(6).to_numpy()
                    flat = np.column_stack([vectors, np.zeros(len(vectors), np.float32)])
                    found, _ = graph.search(flat, max(width, k))
                    found = found[:, :k]
                    ok = found >= 0
                    score = np.zeros(found.shape)
                    for d in range(dim):
                        score += graph.points[np.maximum(found, 0), d].astype(np.float64) * vectors[:, d].astype(np.float64)[:, None]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.broadcast_to(query_ids[:, None], found.shape)[ok]),
                            pa.array(ids[np.maximum(found, 0)][ok]),
                            pa.array(score[ok]),
                        ],
                        ["query_id", "id", "score"],
                    )

    count = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(count, "dim", "shard")
        .sortWithinPartitions("dim", "shard", "side")
        .mapInArrow(tidy(search), "query_id long, id long, score double")
    )


def nearest_neighbours(
    vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, nearest first.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's
    own. The score is the inner product in double precision; ties go to the smaller id. With
    fewer candidates all are given.

    Equal vectors are one node of the index, with the ``k + 1`` smallest of their ids; more of
    them cannot be among the ``k`` nearest of any query. So copies neither crowd a graph nor
    gather in a task.

    Null ids, and vectors that are null, zero, or hold null or non-finite components, take no
    part. Vectors of other lengths than a query's are no candidates of it. A repeated id with
    equal vectors is one row, with different vectors each is a row. Other columns are ignored
    whatever their names.
    """
    rows = usable(vectors, id_col, vector_col).distinct()
    smallest = Window.partitionBy("dim", "vector").orderBy("id")
    members = stage(
        rows.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
        .withColumn("name", F.xxhash64("vector"))
    )
    index = stage(build_index(members.where("place = 1").select("id", "vector", "dim"), shard_rows))
    queries = stage(rows.where(F.col("id") % every == 0))
    found = stage(search_index(index, queries, k + 1, width))
    # Each node stands for its members.
    copies = settle(
        members.select("dim", "name", "vector", F.col("id").alias("copy"))
        .join(members.where("place > 1").select("dim", "name", "vector").distinct(), ["dim", "name", "vector"], "left_semi")
        .join(members.where("place = 1").select("dim", "name", "vector", F.col("id").alias("first")), ["dim", "name", "vector"])
        .select(F.col("first").alias("id"), "copy")
    )
    expanded = join_side(found, copies, ["id"], "left").select(
        "query_id", F.coalesce("copy", "id").alias("vec_id"), "score"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        expanded.where("query_id <> vec_id")
        .distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
    )
