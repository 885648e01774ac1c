"""Words of many UTF-8 texts as numpy arrays.

White space is the ASCII class ``[\\x20\\x09-\\x0D]``, so words can be cut on bytes. Words and
word windows are named by 64-bit hashes that do not depend on the machine, the batch or the
position. Texts are taken in groups of about ``GROUP_BYTES``; a longer text is its own group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

GROUP_BYTES = 1 << 20
# Words are hashed in runs of this many bytes; a longer word gets its hash on its own.
SPAN_BYTES = 1 << 20
LONG_WORD = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = 0xD1342543DE82EF95

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SPAN_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def forget() -> None:
    """Let go of the powers, which are made again when they are needed."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher, which spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes, offsets) of texts taken together; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + GROUP_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), n)
        own = offsets[row : stop + 1]
        yield row, stop, data[own[0] : own[-1]], own - own[0]
        row = stop


@dataclass
class Words:
    """Words of a group: byte positions, hashes, and the words of text i at first[i]:first[i+1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where the words of each text begin."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, first = spans(data, offsets)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(int(np.searchsorted(ends, starts[at] + SPAN_BYTES, "right")), at + 1)
        if stop == at + 1 and ends[at] - starts[at] > LONG_WORD:
            hashes[at] = 0  # named below
        else:
            low, high = int(starts[at]), int(ends[stop - 1])
            terms = (data[low:high].astype(np.uint64) + np.uint64(1)) * _power("up", BASE, high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            s, e = starts[at:stop] - low, ends[at:stop] - low
            hashes[at:stop] = (sums[e] - sums[s]) * _power("down", BASE_INVERSE, high - low)[s]
        at = stop
    lengths = (ends - starts).astype(np.uint64)
    hashes = mix(hashes ^ (lengths * np.uint64(STEP)))
    for i in np.flatnonzero(lengths > LONG_WORD):
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return Words(starts, ends, hashes, first)


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k neighbouring words, by doubling; windows over the end of a text are
    for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    modulus = 1 << 64
    factor = (STEP + 2 * seed) | 1
    total, done = np.zeros(n, np.uint64), 0
    block, width = hashes, 1
    rest = k
    while rest:
        if rest & 1:
            total += block[done : done + n] * np.uint64(pow(factor, done, modulus))
            done += width
        rest >>= 1
        if rest:
            block = block[: len(block) - width] + block[width:] * np.uint64(pow(factor, width, modulus))
            width *= 2
    return mix(total ^ np.uint64((k * STEP + seed) % modulus))
