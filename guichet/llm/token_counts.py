"""Token counts of byte-level BPE vocabularies, without making identifiers."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from guichet.llm.common import internal, on_workers, tidy

# The pattern that byte-level vocabularies split text with before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Bounds of the counts a worker remembers: pieces, and characters of a piece.
REMEMBERED = 400_000
REMEMBERED_LENGTH = 40
# Texts up to this length are split at once, longer ones piece by piece.
AT_ONCE = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {}, 256
    for byte in range(256):
        if byte in shown:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class PieceCounts(dict):
    """Tokens of a piece of text, worked out when first asked for.

    The symbols of a piece are a linked list. A heap holds its adjacent pairs that have a
    merge, lowest rank first and then leftmost; a popped pair that is out of date is passed
    over. Each merge takes one symbol away, so the count is symbols minus merges.
    """

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)
        self.special = [t["content"] for t in model["added_tokens"]]
        ids = model["model"]["vocab"]
        self.first = [ids[letter] for letter in byte_letters()]
        self.merges = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            key = ids[left] << 32 | ids[right]
            self.merges.setdefault(key, (rank, ids[left + right]))

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode())
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def count(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        merges = self.merges
        first = self.first
        symbol = [first[b] for b in data]
        heap = []
        for at in range(n - 1):
            found = merges.get(symbol[at] << 32 | symbol[at + 1])
            if found:
                heap.append((found[0], at, found[1]))
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left = n
        while heap:
            rank, at, merged = heapq.heappop(heap)
            here = symbol[at]
            right = after[at]
            if here < 0 or right >= n:
                continue
            if merges.get(here << 32 | symbol[right], (-1,))[0] != rank:
                continue
            symbol[at] = merged
            symbol[right] = -1
            beyond = after[right]
            after[at] = beyond
            left -= 1
            if beyond < n:
                before[beyond] = at
                found = merges.get(merged << 32 | symbol[beyond])
                if found:
                    heapq.heappush(heap, (found[0], at, found[1]))
            previous = before[at]
            if previous >= 0:
                found = merges.get(symbol[previous] << 32 | merged)
                if found:
                    heapq.heappush(heap, (found[0], previous, found[1]))
        return left


_loaded: dict[str, tuple[PieceCounts, regex.Pattern, regex.Pattern | None]] = {}


def _counter(vocabulary: str):
    if vocabulary not in _loaded:
        _loaded.clear()
        counts = PieceCounts(vocabulary)
        special = sorted(counts.special, key=len, reverse=True)
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        _loaded[vocabulary] = counts, regex.compile(PIECES), cut
    counts, pattern, cut = _loaded[vocabulary]

    def tokens(text: str) -> int:
        parts = cut.split(text) if cut else [text]
        total = len(parts) - 1
        for part in parts:
            if len(part) <= AT_ONCE:
                total += sum(map(counts.__getitem__, pattern.findall(part)))
            else:
                total += sum(counts[m.group()] for m in pattern.finditer(part))
        return total

    return tokens


def count_tokens(
    docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``vocabulary_path`` names a byte-level BPE file in JSON, read on the driver and broadcast
    (a vocabulary is a few MB). Special strings in a text count one token each, as that
    library's default has it; no begin or end is added and nothing is cut.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids give a row each;
    other columns are ignored whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    on_workers(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _counter(vocabulary.value)
        for batch in batches:
            n = [tokens(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    rows = internal(docs, id=id_col, text=text_col).withColumn(
        "n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    )
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(tidy(count), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
