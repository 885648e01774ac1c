"""Quality rules: base rules, and an isolation forest on rule statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from guichet.llm.common import internal, on_workers, tidy
from guichet.llm.text_bytes import SPACE, Words, groups, windows, words
from guichet.operators.settle import is_small, stage

# Base rules.
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"

# Up to so many different rows of features are held on the driver; more stay in tasks.
HELD_VECTORS = 20_000
TREES = 200
ROWS_PER_TREE = 256
# At most this share of the labelled good rows may be rejected by the calibrated threshold.
GOOD_LOSS = 0.002
# Without labels of both kinds there is nothing to calibrate by and the forest rejects nothing.
NO_THRESHOLD = 1.0

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# The forest's rules: a statistic and the value up to which it is ordinary. What counts is how
# far a document is beyond it, so ordinary variation sets no document apart.
RULES = {
    "symbol_share": 0.1,  # symbols per word
    "dup_line_share": 0.4,  # repeated lines per line with a word
    "repeat_share": 0.25,  # repeated words per word
    "same_word_share": 0.1,  # words equal to the word before, per word
    "upper_share": 0.3,  # capitals A-Z per character
    "digit_share": 0.3,  # digits per character
    "mark_share": 0.5,  # other ASCII marks per word
    "word_length": 10.0,  # characters per word
    "word_shortness": 0.4,  # words per character
}
FEATURES = list(RULES)


def _table(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


IS_SYMBOL = _table(SYMBOLS)
IS_UPPER = _table(bytes(range(65, 91)))
IS_MARK = _table(b"!?;:\"'()[]{}=~^_\\/@+`")
IS_DIGIT = _table(b"0123456789")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(found: Words, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, the words inside windows of k words that its text has twice or more."""
    n_texts, n_words = len(found.first) - 1, len(found.hashes)
    covered = np.zeros(n_texts, np.int64)
    if n_words < k:
        return covered
    owner = np.repeat(np.arange(n_texts), found.counts())
    starts = np.flatnonzero(owner[: n_words - k + 1] == owner[k - 1 :])
    # The text is mixed into the hash, so that windows of other texts differ.
    salt = (owner[starts].astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    named = windows(found.hashes, k)[starts] ^ salt
    order = np.argsort(named, kind="stable")
    same = named[order[1:]] == named[order[:-1]]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts[twice], 1)
    np.add.at(change, starts[twice] + k, -1)
    inside = np.cumsum(change[:-1]) > 0
    return np.bincount(owner[inside], minlength=n_texts)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts and the forest's features of every text."""
    parts: list[dict[str, np.ndarray]] = []
    for _, _, data, offsets in groups(texts):
        found = words(data, offsets)
        in_word = ~SPACE[data]
        lines = np.zeros(len(offsets) - 1, np.int64)
        repeats = np.zeros(len(offsets) - 1, np.int64)
        for i in range(len(offsets) - 1):
            own = [x for x in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
            lines[i], repeats[i] = len(own), len(own) - len(set(own))
        part = {
            "n_words": found.counts(),
            "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), offsets),
            "n_symbols": _per_text(IS_SYMBOL[data], offsets),
            "n_dup_lines": repeats,
            "n_repeat_words": repeated_words(found),
        }
        same = np.zeros(len(found.hashes) + 1, np.int64)
        if len(found.hashes):
            owner = np.repeat(np.arange(len(offsets) - 1), found.counts())
            again = (found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])
            np.cumsum(again, out=same[2:])
        some = np.maximum(part["n_words"], 1)
        letters = np.maximum(part["word_chars"], 1)
        parts.append(
            part
            | {
                "word_length": part["word_chars"] / some,
                "word_shortness": part["n_words"] / letters,
                "same_word_share": (same[found.first[1:]] - same[found.first[:-1]]) / some,
                "symbol_share": part["n_symbols"] / some,
                "dup_line_share": repeats / np.maximum(lines, 1),
                "repeat_share": part["n_repeat_words"] / some,
                "upper_share": _per_text(IS_UPPER[data], offsets) / letters,
                "mark_share": _per_text(IS_MARK[data], offsets) / some,
                "digit_share": _per_text(IS_DIGIT[data], offsets) / letters,
            }
        )
    if not parts:
        return {name: np.zeros(0) for name in COUNTS + FEATURES}
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (
        100 * stats["n_repeat_words"] > MAX_REPEATED_PERCENT * stats["n_words"]
    )


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Per rule, the logarithm of the statistic over its ordinary value, at least 0."""
    return np.column_stack([np.log(np.maximum(stats[name] / most, 1.0)) for name, most in RULES.items()])


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of a search for a missing key among n."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 3)
    long = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n < 2, 0.0, np.where(n < 3, 1.0, long))


@dataclass
class Forest:
    """Trees as heaps: node i splits ``feature`` at ``cut``, a leaf has feature -1 and its
    expected path length in ``path``."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    depth: int
    normal: float
    threshold: float = NO_THRESHOLD

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Near 1 for rows that random splits set apart early, below 0.5 for ordinary ones."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for tree in range(len(self.feature)):
            feature, cut, path = self.feature[tree], self.cut[tree], self.path[tree]
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                split = feature[at]
                right = rows[at_row, np.maximum(split, 0)] >= cut[at]
                at = np.where(split < 0, at, 2 * at + 1 + right)
            total += path[at]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.normal)


def grow_forest(
    rows: np.ndarray, trees: int = TREES, size: int = ROWS_PER_TREE, seed: int = 7, counts: np.ndarray | None = None
) -> Forest:
    """An isolation forest; equal rows cannot be parted and end in one leaf.

    ``counts`` says how many rows each of ``rows`` stands for (one by default).
    """
    upto = np.cumsum(np.ones(len(rows), np.int64) if counts is None else counts)
    n = int(upto[-1]) if len(upto) else 0
    random = np.random.default_rng(seed)
    drawn = (rows[np.searchsorted(upto, random.choice(n, min(size, n), replace=False), "right")] for _ in range(trees if n else 0))
    return _grown(((own, random) for own in drawn), trees, min(size, n))


def _grown(samples: Iterable[tuple[np.ndarray, np.random.Generator]], trees: int, size: int) -> Forest:
    """A tree on each sample of ``size`` rows, split by the draws that come with it."""
    size = max(size, 1)
    depth = max(math.ceil(math.log2(size)), 1)
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1, np.int64)
    cut, path = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for tree, (sample, random) in enumerate(samples):
        stack = [(0, 0, sample)]
        while stack:
            node, level, own = stack.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            able = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(able):
                path[tree, node] = level + expected_path(len(own))
                continue
            f = random.choice(able)
            c = random.uniform(low[f], high[f])
            c = high[f] if c <= low[f] else c
            feature[tree, node], cut[tree, node] = f, c
            right = own[:, f] >= c
            stack += [(2 * node + 1, level + 1, own[~right]), (2 * node + 2, level + 1, own[right])]
    return Forest(feature, cut, path, depth, float(max(expected_path(size), 1.0)))


def calibrate(scores: np.ndarray, good: np.ndarray, bad: np.ndarray | None = None, most_lost: float = GOOD_LOSS) -> float:
    """The score above which a row is rejected: it parts good from bad labels best among
    those that lose at most a given share of the good ones.

    ``good`` and ``bad`` count the labels behind a score; without ``bad`` each score is one row.
    """
    bad = ~good if bad is None else bad
    if not good.any() or not bad.any():
        return NO_THRESHOLD
    values, where = np.unique(scores, return_inverse=True)
    good, bad = (np.bincount(where, n) for n in (good, bad))
    return _best_cut(values, good, bad, (0, 0), (good.sum(), bad.sum()), None, most_lost)[1]


def _best_cut(
    values: np.ndarray, good: np.ndarray, bad: np.ndarray, before: tuple, total: tuple, following: float | None, most_lost: float
) -> tuple[float, float]:
    """(what the best cut parts, that cut) of the cuts right above each of the ascending scores.

    ``before`` counts the good and bad labels of lower scores, ``total`` all; ``following`` is the next score.
    """
    after = values[1:] if following is None else np.append(values[1:], following)
    low = values[: len(after)]
    middle = (low + after) / 2
    cuts = np.where(middle < after, middle, low)
    if following is None:
        cuts = np.append(cuts, NO_THRESHOLD)
    lost, caught = (1 - (n + np.cumsum(counts)) / all_ for n, counts, all_ in zip(before, (good, bad), total))
    allowed = np.where(lost <= most_lost, caught - lost, -1.0)
    at = len(cuts) - 1 - int(np.argmax(allowed[::-1]))
    return float(allowed[at]), float(cuts[at])


def fit_forest(
    docs: DataFrame,
    labels: DataFrame,
    trees: int = TREES,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Forest:
    """Fit and calibrate on all labelled documents.

    Every tree draws its rows from all of them, and every one counts in the calibration. Equal
    rows of features are counted; where few differ, the driver holds them, else they stay in tasks
    and it sees the drawn rows alone. Rows that fail the base rules take no part. Contradicting labels
    of an id count as bad; null labels are left out. Without labels the forest is empty or uncalibrated and
    rejects nothing.
    """
    on_workers(docs.sparkSession)
    vectors = stage(_labelled_vectors(docs, labels, id_col, text_col, label_col))
    if vectors.count() > HELD_VECTORS:
        return _fit_apart(vectors, trees)
    # In the order of their hash, so the draws do not depend on the partitioning.
    table = vectors.orderBy(F.xxhash64(*FEATURES), *FEATURES).toArrow()
    good, bad = (table.column(c).to_numpy() for c in ("n_good", "n_bad"))
    values = _matrix(table)
    forest = grow_forest(values, trees, counts=good + bad)
    forest.threshold = calibrate(forest.scores(values), good, bad)
    return forest


_VECTOR = ", ".join(f"{f} double" for f in FEATURES)


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.column_stack([table.column(f).to_numpy() for f in FEATURES])


def _labelled_vectors(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(features, n_good, n_bad): how many labelled documents that pass the base rules have the same features."""
    good = F.nanvl(F.min("good").cast("double"), F.lit(0.0)) > 0
    chosen = stage(
        internal(labels, id=id_col, good=label_col).where("id IS NOT NULL AND good IS NOT NULL").groupBy("id").agg(good.alias("good"))
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(1))
            ok = ~base_failed(stats)
            values = [pa.array(v) for v in features(stats)[ok].T]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), *values], [batch.schema.names[0], *FEATURES])

    rows = internal(docs, id=id_col, text=text_col)
    if is_small(chosen):
        labelled = rows.join(F.broadcast(chosen), "id").select("good", "text").mapInArrow(tidy(measure), f"good boolean, {_VECTOR}")
    else:
        # Texts stay where they are; what is measured of them is joined.
        kind = rows.schema["id"].dataType.simpleString()
        labelled = rows.where("id IS NOT NULL").mapInArrow(tidy(measure), f"id {kind}, {_VECTOR}").join(chosen, "id")
    return labelled.groupBy(*FEATURES).agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))


def _parts(df: DataFrame, order: list[str]) -> tuple[DataFrame, list]:
    """(rows with the number of their range of ``order``, per range in order what it begins with and counts)."""
    parts = stage(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.min(order[0]).alias("first"), F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad"))
    # One row per range.
    return parts, sums.orderBy("part").collect()


def _fit_apart(vectors: DataFrame, trees: int, size: int = ROWS_PER_TREE, seed: int = 7) -> Forest:
    """The forest with its threshold, the rows left in tasks."""
    spark = vectors.sparkSession
    parts, sums = _parts(vectors, FEATURES)
    upto = [0, *accumulate(r["n_good"] + r["n_bad"] for r in sums)]
    begin = {r["part"]: n for r, n in zip(sums, upto)}
    size = min(size, upto[-1])
    randoms = [np.random.default_rng([seed, tree]) for tree in range(trees)]
    places = [random.choice(upto[-1], size, replace=False) for random in randoms]
    asked = np.unique(np.concatenate(places))

    def drawn(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(f, "ascending") for f in FEATURES])
        n = table.column("n_good").to_numpy() + table.column("n_bad").to_numpy()
        ends = begin[key[0].as_py()] + np.cumsum(n)
        low, high = np.searchsorted(asked, ends - n), np.searchsorted(asked, ends)
        rows = np.repeat(np.arange(len(n)), high - low)
        return table.select(FEATURES).take(pa.array(rows)).append_column("place", pa.array(asked[low[0] : high[-1]]))

    found = parts.groupBy("part").applyInArrow(drawn, f"{_VECTOR}, place long").toArrow().sort_by("place")
    values = _matrix(found)
    forest = _grown(((values[np.searchsorted(asked, own)], random) for own, random in zip(places, randoms)), trees, size)

    model = spark.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.value.scores(_matrix(batch)))
            yield pa.RecordBatch.from_arrays([scores, batch.column("n_good"), batch.column("n_bad")], ["score", "n_good", "n_bad"])

    scored = vectors.mapInArrow(score, "score double, n_good long, n_bad long")
    scored = stage(scored.groupBy("score").agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad")))
    parts, sums = _parts(scored, ["score"])
    good, bad = ([0, *accumulate(r[c] for r in sums)] for c in ("n_good", "n_bad"))
    if not good[-1] or not bad[-1]:
        return forest
    following = [*[r["first"] for r in sums[1:]], None]
    known = {r["part"]: state for r, *state in zip(sums, zip(good, bad), following)}

    def best(key: tuple, table: pa.Table) -> pa.Table:
        before, after = known[key[0].as_py()]
        own = [c.to_numpy() for c in table.sort_by("score").select(["score", "n_good", "n_bad"]).columns]
        parted, cut = _best_cut(*own, before, (good[-1], bad[-1]), after, GOOD_LOSS)
        return pa.table({"parted": [parted], "cut": [cut]})

    # One row per range.
    cuts = parts.groupBy("part").applyInArrow(best, "parted double, cut double").collect()
    forest.threshold = max((r["parted"], r["cut"]) for r in cuts)[1]
    return forest


def _verdicts(texts: pa.Array, forest: Forest) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    stats = statistics(texts)
    failed = base_failed(stats)
    score = forest.scores(features(stats)) if len(failed) else np.zeros(0)
    return stats, failed, score, ~failed & (score <= forest.threshold)


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, the counts, ``base_failed``, ``score`` and ``kept``.

    A null, empty or blank text has no words and fails the base rules. Repeated rows and null
    ids give a row each; other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    on_workers(spark)
    model = spark.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, failed, scores, kept = _verdicts(batch.column(1), model.value)
            counts = [pa.array(stats[c].astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(failed.astype(bool)), pa.array(scores), pa.array(kept.astype(bool))],
                ["id", *COUNTS, "base_failed", "score", "kept"],
            )

    rows = internal(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(tidy(score), f"id {kind}, {longs}, base_failed boolean, score double, kept boolean").withColumnRenamed(
        "id", id_col
    )


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    spark = docs.sparkSession
    on_workers(spark)
    model = spark.sparkContext.broadcast(forest)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _verdicts(batch.column(at), model.value)[3]
            yield batch.filter(pa.array(kept.astype(bool)))

    return docs.mapInArrow(tidy(keep), docs.schema)
