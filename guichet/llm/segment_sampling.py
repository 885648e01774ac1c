"""SentencePiece encoding by sampling without replacement, and decoding."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from guichet.llm.common import by_bytes, internal, on_workers, tidy
from guichet.llm.text_bytes import BASE, BASE_INVERSE, _power, mix, uniform

SAMPLES = 2
# A piece of rank r has probability proportional to r ** -EXPONENT, and a byte of a character
# without a piece is this much less likely than the rarest piece.
EXPONENT = 1.0
BYTE_PENALTY = 10.0
SEED = 11
# Bytes of documents that are taken together; a longer document is taken alone.
CHUNK = 1 << 18
# Steps of a path, and random numbers, that are made ready at a time.
AHEAD = 64

SPACE = "▁"


class Vocabulary:
    """Pieces of a SentencePiece model as a trie over characters, in numpy arrays."""

    def __init__(self, model: bytes, exponent: float = EXPONENT):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that keep the text and add a space in front are supported")
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        self.bytes = np.full(256, -1, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the model has no piece for every byte")
        # A space begins a piece or the piece is all spaces, so text can be cut before spaces.
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in normal):
            raise ValueError("pieces with a space inside are not supported")

        # What ids stand for, as bytes of the text with its marked spaces.
        blobs = [p.piece.encode() if p.type == 1 else b"" for p in proto.pieces]
        for value, i in enumerate(self.bytes):
            blobs[i] = bytes([value])
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_length = np.array([len(b) for b in blobs], np.int64)
        self.blob_start = np.cumsum(self.blob_length) - self.blob_length

        by_rank = sorted(normal, key=lambda x: (-x[2], x[0]))
        weights = np.arange(1, len(by_rank) + 1, dtype=np.float64) ** -exponent
        self.log_prob = np.full(len(proto.pieces), -np.inf)
        self.log_prob[[i for i, _, _ in by_rank]] = np.log(weights / weights.sum())
        self.byte_log_prob = float(np.log(weights[-1] / weights.sum())) - BYTE_PENALTY

        letters = sorted({c for _, p, _ in normal for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        children: dict[int, int] = {}
        piece = [-1]
        for i, p, _ in normal:
            state = 0
            for c in p:
                key = state * self.letters + int(self.letter[ord(c)])
                if key not in children:
                    children[key] = len(piece)
                    piece.append(-1)
                state = children[key]
            piece[state] = i
        self.piece = np.array(piece, np.int32)
        self.longest = max(len(p) for _, p, _ in normal)
        self._hash(children)

    def _hash(self, children: dict[int, int]) -> None:
        size = 1 << max(int(len(children) * 4).bit_length(), 4)
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        for key, value in children.items():
            at = self._slot(np.array([key]))[0]
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * BASE) >> np.uint64(40)).astype(np.int64) & self.mask

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The trie states after one more letter, -1 where there is none."""
        wanted = states * self.letters + letters
        at = self._slot(wanted)
        found = self.keys[at]
        out = np.where(found == wanted, self.values[at], -1)
        open_ = np.flatnonzero((found != wanted) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == wanted[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.blob_length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.blob_start[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        text = self.decode_bytes(ids).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@dataclass
class Lattice:
    """The lattices of distinct segments. Nodes are numbered by their distance to the end of
    their segment; ``edge_target`` is -1 at the end. ``edge_log`` is the logarithm of an edge's
    share of all ways from its node to the end, and ``edge_upto`` sums up these shares."""

    first: np.ndarray
    edge_target: np.ndarray
    edge_log: np.ndarray
    edge_upto: np.ndarray
    edge_id: np.ndarray  # a piece, or -1 - code point
    entry: np.ndarray  # the first node of each segment

    def __post_init__(self):
        counts = np.diff(self.first)
        self.edge_low = np.repeat(self.first[:-1], counts)
        self.edge_high = np.repeat(self.first[1:], counts)


def build_lattice(vocabulary: Vocabulary, points: np.ndarray, starts: np.ndarray) -> Lattice:
    """``starts`` are where segments begin in ``points``, with the end of the last."""
    n = len(points)
    lengths = np.diff(starts)
    ends = np.repeat(starts[1:], lengths)
    to_end = ends - np.arange(n)
    small = to_end.astype(np.uint16) if n and to_end.max() < 65536 else to_end
    order = np.argsort(small, kind="stable")  # rank -> position
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    letters = vocabulary.letter[points].astype(np.int64)

    positions, states = np.arange(n), np.zeros(n, np.int64)
    froms, tos, ids = [], [], []
    single = np.zeros(n, bool)
    for length in range(1, vocabulary.longest + 1):
        inside = positions + length <= ends[positions]
        positions, states = positions[inside], states[inside]
        if not len(positions):
            break
        states = vocabulary.step(states, letters[positions + length - 1]).astype(np.int64)
        alive = states >= 0
        positions, states = positions[alive], states[alive]
        piece = vocabulary.piece[states]
        whole = piece >= 0
        if length == 1:
            single[positions[whole]] = True
        froms.append(positions[whole])
        tos.append(positions[whole] + length)
        ids.append(piece[whole].astype(np.int64))
    bare = np.flatnonzero(~single)
    froms.append(bare)
    tos.append(bare + 1)
    ids.append(-1 - points[bare].astype(np.int64))

    counts = np.zeros(n, np.int64)
    for f in froms:
        counts[rank[f]] += 1
    first = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    filled = first[:-1].copy()
    total = int(first[-1])
    edge_id, edge_target = np.empty(total, np.int64), np.empty(total, np.int64)
    for f, t, i in zip(froms, tos, ids):
        r = rank[f]
        at = filled[r]
        filled[r] += 1
        edge_id[at] = i
        edge_target[at] = np.where(t == ends[f], -1, rank[np.minimum(t, n - 1)])
    points_ = np.maximum(-1 - edge_id, 0)
    n_bytes = 1 + (points_ > 0x7F) + (points_ > 0x7FF) + (points_ > 0xFFFF)
    edge_log = np.where(edge_id >= 0, vocabulary.log_prob[np.maximum(edge_id, 0)], vocabulary.byte_log_prob * n_bytes)

    # Sums over all ways to the end, node by node from the end; the last entry stands for it.
    beyond = np.zeros(n + 1)
    sizes = np.bincount(to_end, minlength=1) if n else np.zeros(1, np.int64)
    low = 0
    for size in sizes[1:]:
        high = low + int(size)
        if high == low:
            continue
        a, b = first[low], first[high]
        value = edge_log[a:b] + beyond[edge_target[a:b]]
        cut = first[low:high] - a
        top = np.maximum.reduceat(value, cut)
        per = counts[low:high]
        shares = np.exp(value - np.repeat(top, per))
        sums = np.add.reduceat(shares, cut)
        beyond[low:high] = top + np.log(sums)
        edge_log[a:b] = value - np.repeat(beyond[low:high], per)
        low = high
    sums = np.cumsum(np.exp(edge_log))
    before = np.concatenate([[0.0], sums])[first[:-1]]
    edge_upto = sums - np.repeat(before, counts)
    entry = rank[starts[:-1]] if n else np.zeros(0, np.int64)
    return Lattice(first, edge_target, edge_log, edge_upto, edge_id, entry)


def _walk(lattice: Lattice, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each node a random way to the end, by the shares of its edges.

    Gives the edges of all ways one after another, and how many each way has. ``keys`` seed the
    choices of a way, whatever it is taken together with.
    """
    counts = np.zeros(len(nodes), np.int64)
    steps, ways = [], np.arange(len(nodes))
    number = 0
    while len(ways):
        u = uniform(keys[ways] + np.uint64(number * 0xBF58476D1CE4E5B9 % (1 << 64)))
        edge, last = lattice.first[nodes], lattice.first[nodes + 1] - 1
        more = np.flatnonzero((u > lattice.edge_upto[edge]) & (edge < last))
        while len(more):
            edge[more] += 1
            more = more[(u[more] > lattice.edge_upto[edge[more]]) & (edge[more] < last[more])]
        steps.append((ways, edge))
        counts[ways] += 1
        nodes = lattice.edge_target[edge]
        going = nodes >= 0
        ways, nodes = ways[going], nodes[going]
        number += 1
    first = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int64)
    for number, (own, edge) in enumerate(steps):
        flat[first[own] + number] = edge
    return flat, counts


@dataclass
class _Search:
    """The agenda of one document: sets of segmentations, by the highest perturbed value in them.

    A set is either "agrees with path p before step t and leaves it at t or later" (taken is
    None), or "agrees with p before step t and takes none of the edges ``taken`` there".
    """

    random: Callable[[], float]
    agenda: list = field(default_factory=list)
    paths: list = field(default_factory=list)  # edges, and which segment each edge is of
    logs: list = field(default_factory=list)  # of the first edges, as far as they were needed
    totals: list = field(default_factory=list)
    values: list = field(default_factory=list)
    count: int = 0

    def push(self, mass: float, below: float, path: int, step: int, reached: float, taken: tuple | None) -> None:
        """A set of log mass ``mass``: its highest value, given that it is under ``below``."""
        if mass == -math.inf:
            return
        noise = math.log(-math.log(self.random())) - mass
        rank = max(-below, noise) + math.log1p(math.exp(-abs(below + noise)))
        self.count += 1
        heapq.heappush(self.agenda, (rank, self.count, path, step, reached, taken))

    def next_divergence(self, lattice: Lattice) -> tuple[int, int, int, float] | None:
        """Take the best set apart down to an edge: (path, step, edge, log share up to it)."""
        if not self.agenda:
            return None
        value, _, path, step, reached, taken = heapq.heappop(self.agenda)
        value = -value
        edges, logs, total = self.paths[path][0], self.logs[path], self.totals[path]
        while taken is None:
            while step >= len(logs):
                logs += lattice.edge_log[edges[len(logs) : len(logs) + AHEAD]].tolist()
            own = logs[step]
            # A node with one edge has a share of 1 up to rounding.
            aside = reached + math.log(-math.expm1(own)) if own < -1e-13 else -math.inf
            deeper = _minus(reached + own, total) if step + 1 < len(edges) else -math.inf
            if aside == -math.inf and deeper == -math.inf:
                return self.next_divergence(lattice)
            if aside != -math.inf and (deeper == -math.inf or self.random() < 1 / (1 + math.exp(min(deeper - aside, 700.0)))):
                self.push(deeper, value, path, step + 1, reached + own, None)
                taken = (int(edges[step]),)
            else:
                self.push(aside, value, path, step, reached, (int(edges[step]),))
                reached, step = reached + own, step + 1
        node_first, node_last = int(lattice.edge_low[taken[0]]), int(lattice.edge_high[taken[0]])
        free = [e for e in range(node_first, node_last) if e not in taken]
        shares = np.exp(lattice.edge_log[free])
        at = int(np.searchsorted(np.cumsum(shares), self.random() * shares.sum()))
        edge = free[min(at, len(free) - 1)]
        rest = float(shares.sum() - math.exp(lattice.edge_log[edge]))
        if len(free) > 1 and rest > 0:
            self.push(reached + math.log(rest), value, path, step, reached, (*taken, edge))
        self.values.append(value)
        return path, step, edge, reached + float(lattice.edge_log[edge])


def _minus(a: float, b: float) -> float:
    """log(exp(a) - exp(b)) for a >= b; nothing is left if they are equal up to rounding."""
    return -math.inf if b >= a - 1e-12 else a + math.log1p(-math.exp(b - a))


def _stream(key: int) -> Callable[[], float]:
    """Numbers in (0, 1), the same for the same key."""

    def blocks() -> Iterator[float]:
        at = 0
        while True:
            yield from uniform(np.uint64(key) + (np.arange(at, at + AHEAD, dtype=np.uint64) + np.uint64(1)) * BASE).tolist()
            at += AHEAD

    return blocks().__next__


def _segments(vocabulary: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts with marked spaces, where segments begin, and the segments of
    text i at first[i]:first[i+1]. No piece reaches over the begin of a segment."""
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
    begins = np.zeros(len(points) + 1, bool)
    begins[offsets] = True
    space = points == ord(SPACE)
    begins[1:-1] |= space[1:] & ~space[:-1]
    bare = vocabulary.letter[points] == 0
    begins[:-1] |= bare
    begins[1:] |= bare
    starts = np.flatnonzero(begins)
    return points, starts, np.searchsorted(starts, offsets)


def sample_texts(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text up to ``k`` distinct segmentations, best perturbed value first: (ids, log
    probability, log inclusion probability).

    Gumbel top-k: each segmentation's log probability is perturbed and the ``k`` highest are
    taken, which samples without replacement. The search is best-first and exact: the highest
    perturbed value of a set of segmentations is drawn from their summed probability, and only
    the best set is taken apart. With the (k+1)-th value as threshold the inclusion
    probability of a sample is 1 - exp(-exp(log probability - threshold)).
    """
    out: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
    points, starts, first = _segments(vocabulary, texts)
    if len(points) == 0:
        return out
    # Equal segments share a lattice.
    terms = (points.astype(np.uint64) + np.uint64(1)) * _power("up", BASE, len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    lengths = np.diff(starts)
    names = mix((sums[starts[1:]] - sums[starts[:-1]]) * _power("down", BASE_INVERSE, len(points))[starts[:-1]] ^ lengths.astype(np.uint64))
    _, where, kind = np.unique(names, return_index=True, return_inverse=True)
    own = lengths[where]
    own_starts = np.concatenate([[0], np.cumsum(own)])
    gather = np.repeat(starts[where] - own_starts[:-1], own) + np.arange(own_starts[-1])
    lattice = build_lattice(vocabulary, points[gather], own_starts)
    entry = lattice.entry[kind]

    segments = np.arange(len(entry))
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    within = (segments - first[text_of]).astype(np.uint64)

    def way_keys(own_segments: np.ndarray, number: int) -> np.ndarray:
        base = keys[text_of[own_segments]] + np.uint64((number + 1) * 0xA0761D6478BD642F % (1 << 64))
        return mix(base ^ (within[own_segments] + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))

    busy = [i for i in range(len(texts)) if first[i + 1] > first[i]]
    searches = {i: _Search(_stream(int(mix(keys[i : i + 1])[0]))) for i in busy}

    flat, counts = _walk(lattice, entry, way_keys(segments, 0))
    flat_first = np.concatenate([[0], np.cumsum(counts)])
    segment_of = np.repeat(segments, counts)
    for i in busy:
        low, high = flat_first[first[i]], flat_first[first[i + 1]]
        search = searches[i]
        search.paths.append((flat[low:high], segment_of[low:high]))
        search.logs.append([])
        search.totals.append(float(lattice.edge_log[flat[low:high]].sum()))
        top = -math.log(-math.log(search.random()))
        search.values.append(top)
        search.push(_minus(0.0, search.totals[0]), top, 0, 0, 0.0, None)

    for number in range(1, k):
        turns = []
        for i in busy:
            found = searches[i].next_divergence(lattice)
            if found is not None:
                turns.append((i, found))
        if not turns:
            break
        # The rest of the segment that the path is left in, and all segments behind it.
        begin = np.array([int(searches[i].paths[path][1][step]) for i, (path, step, _, _) in turns])
        stop = np.array([first[i + 1] for i, _ in turns])
        target = lattice.edge_target[[edge for _, (_, _, edge, _) in turns]]
        sizes = stop - begin
        ways_first = np.concatenate([[0], np.cumsum(sizes)])
        ways = np.repeat(begin - ways_first[:-1], sizes) + np.arange(ways_first[-1])
        nodes = entry[ways]
        nodes[ways_first[:-1]] = target
        open_ = nodes >= 0
        edges, own_counts = _walk(lattice, nodes[open_], way_keys(ways[open_], number))
        all_counts = np.zeros(len(ways), np.int64)
        all_counts[open_] = own_counts
        edges_first = np.concatenate([[0], np.cumsum(all_counts)])
        own_segment = np.repeat(ways, all_counts)
        for turn, (i, (path, step, edge, reached)) in enumerate(turns):
            search = searches[i]
            low, high = edges_first[ways_first[turn]], edges_first[ways_first[turn + 1]]
            old_edges, old_segments = search.paths[path]
            new = np.concatenate([old_edges[:step], [edge], edges[low:high]])
            search.logs.append([])
            search.paths.append((new, np.concatenate([old_segments[: step + 1], own_segment[low:high]])))
            search.totals.append(reached + float(lattice.edge_log[edges[low:high]].sum()))
            if step + 1 < len(new):
                search.push(_minus(reached, search.totals[-1]), search.values[-1], len(search.paths) - 1, step + 1, reached, None)

    for i in busy:
        search = searches[i]
        threshold = -search.agenda[0][0] if search.agenda and len(search.paths) == k else -math.inf
        for (edges, _), total in zip(search.paths, search.totals):
            odds = total - threshold
            log_inclusion = 0.0 if threshold == -math.inf or odds > 3.6 else (odds if odds < -30 else math.log(-math.expm1(-math.exp(odds))))
            out[i].append((_ids(vocabulary, lattice.edge_id[edges]), total, log_inclusion))
    return out


def _ids(vocabulary: Vocabulary, edge_ids: np.ndarray) -> np.ndarray:
    """Piece ids; a character without a piece is the ids of its bytes."""
    bare = edge_ids < 0
    if not bare.any():
        return edge_ids.astype(np.int32)
    points = -1 - edge_ids
    ascii_ = bare & (points < 128)
    edge_ids = np.where(ascii_, vocabulary.bytes[np.where(ascii_, points, 0)], edge_ids)
    parts, at = [], 0
    for place in np.flatnonzero(bare & ~ascii_):
        parts.append(edge_ids[at:place])
        parts.append(vocabulary.bytes[list(chr(int(points[place])).encode())])
        at = place + 1
    return np.concatenate([*parts, edge_ids[at:]]).astype(np.int32)


_loaded: dict[tuple[bytes, float], Vocabulary] = {}


def _vocabulary(model: bytes, exponent: float) -> Vocabulary:
    if (model, exponent) not in _loaded:
        _loaded.clear()
        _loaded[model, exponent] = Vocabulary(model, exponent)
    return _loaded[model, exponent]


def sample_segmentations(
    docs: DataFrame, model_path: str, k: int = SAMPLES, exponent: float = EXPONENT, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, sample, ids, log_prob, log_inclusion, round_trip``: up to ``k`` distinct sampled
    segmentations of every whole text.

    ``model_path`` names a SentencePiece model with byte pieces, read on the driver and broadcast
    (well under a MB). A text's choices are seeded by its id, so reruns and other
    partitionings agree. ``round_trip`` says whether decoding gives the text back, which it
    does unless the text has U+2581, the mark of a space.

    A null or empty text gives one row with no ids, log probability and log inclusion 0. A text
    with fewer than ``k`` segmentations gives all of them, each with log inclusion 0. Repeated
    rows of an id and text give equal samples, rows without an id are seeded alike. Other columns
    are ignored whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    on_workers(spark)
    with open(model_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model.value, exponent)
        for batch in by_bytes(batches, 1, CHUNK):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = batch.column(2).to_numpy().view(np.uint64)
            rows, numbers, logs, inclusions, same, values = [], [], [], [], [], []
            for i, found in enumerate(sample_texts(vocabulary, texts, keys, k)):
                for number, (ids, log_prob, log_inclusion) in enumerate(found or [(np.zeros(0, np.int32), 0.0, 0.0)]):
                    rows.append(i)
                    numbers.append(number + 1)
                    logs.append(log_prob)
                    inclusions.append(log_inclusion)
                    same.append(vocabulary.decode(ids) == texts[i])
                    values.append(ids)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32()), pa.array(np.concatenate(values), pa.int32())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(numbers, pa.int32()), lists, pa.array(logs), pa.array(inclusions), pa.array(same)],
                ["id", "sample", "ids", "log_prob", "log_inclusion", "round_trip"],
            )

    rows = internal(docs, id=id_col, text=text_col).withColumn("key", F.xxhash64(F.lit(seed), F.col("id")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        tidy(sample), f"id {kind}, sample int, ids array<int>, log_prob double, log_inclusion double, round_trip boolean"
    ).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in a column ``out``, which must be a new name."""
    spark = encoded.sparkSession
    on_workers(spark)
    with open(model_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())
    at = encoded.columns.index(ids_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model.value, EXPONENT)
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode(np.array(ids, np.int64)) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    fields = encoded.schema.fields[:]
    return encoded.mapInArrow(tidy(apply), type(encoded.schema)(fields).add(out, "string"))
