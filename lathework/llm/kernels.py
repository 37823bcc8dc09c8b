"""What the scans of several operators share; runs in Python workers, without Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C55
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``k`` consecutive codes, in order: a polynomial of the seed's own base."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64((0xD6E8FEB86659FD93 + 0x5851F42D4C957F2A * seed) & 0xFFFFFFFFFFFFFFFF)
    total = codes[:n].copy()
    for j in range(1, k):
        total *= base
        total += codes[j : j + n]
    return mix(total, seed)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


#: Polynomials modulo 2^64 repeat for long regular spans, so longer ones are hashed in pieces of this many values.
PIECE = 32


def spans_of_pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of some spans: their starts and ends, their numbers within the span, and where each span's begin."""
    counts = -(-(ends - starts) // PIECE)
    first = np.cumsum(counts) - counts
    number = np.arange(int(counts.sum())) - np.repeat(first, counts)
    begin = np.repeat(starts, counts) + number * PIECE
    return begin, np.minimum(begin + PIECE, np.repeat(ends, counts)), number, first


class SpanHash:
    """64-bit hashes of spans of an integer array, from prefix sums of a random table's powers.

    A span of over ``PIECE`` values is the sum of its pieces' hashes, each mixed with its place.
    """

    def __init__(self):
        self._table = mix(np.arange(256, dtype=np.uint64), 17)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self._up = np.full(n, _BASE, np.uint64)
        self._down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        self._up[0] = self._down[0] = 1
        np.cumprod(self._up, out=self._up)
        np.cumprod(self._down, out=self._down)

    def of_values(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(values) + 1 > len(self._up):
            self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._up[: len(values)], out=sums[1:])
        out = self._polynomial(sums, starts, ends)
        long = np.flatnonzero(ends - starts > PIECE)
        if len(long):
            begin, end, number, first = spans_of_pieces(starts[long], ends[long])
            parts = mix(self._polynomial(sums, begin, end) ^ mix(number.astype(np.uint64), 31), 37)
            out[long] = mix(np.add.reduceat(parts, first) + (ends - starts)[long].astype(np.uint64), 41)
        return out

    def _polynomial(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def of_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.of_values(self._table[data], starts, ends)

    def of_points(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.of_values(mix(points.astype(np.uint64), 23), starts, ends)


class Words:
    """The words (runs without ASCII white space) of some consecutive texts.

    ``first`` is the number of the first text; ``of[i]`` the text of word ``i`` counted from
    it; ``bounds`` where each text's words begin; ``codes`` the words' hashes.
    """

    def __init__(self, first, n, data, starts, ends, of, codes):
        self.first, self.n, self.data, self.starts, self.ends, self.of, self.codes = first, n, data, starts, ends, of, codes
        self.bounds = np.searchsorted(of, np.arange(n + 1))

    def text(self, i: int) -> np.ndarray:
        return self.codes[self.bounds[i] : self.bounds[i + 1]]


def scan_words(column: pa.Array, hasher: SpanHash):
    """``Words`` of the column's texts, some ``CHUNK_BYTES`` at a time, whole texts each; nulls are empty."""
    array = column.cast(pa.large_binary()).fill_null(b"")
    if not len(array):
        return
    _, offsets, values = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    values = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(array):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, len(array))
        data = values[offsets[lo] : offsets[hi]]
        edges = offsets[lo : hi + 1] - offsets[lo]
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        cut = np.zeros(len(data) + 1, bool)  # a text begins here
        cut[edges] = True
        before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
        after = np.concatenate([solid[1:], [False]]) if len(data) else solid
        starts = np.flatnonzero(solid & (~before | cut[:-1]))
        ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
        of = np.searchsorted(edges, starts, "right") - 1
        yield Words(lo, hi - lo, data, starts, ends, of, hasher.of_bytes(data, starts, ends))
        lo = hi
