"""Words and runs of words of many texts at once: places and 64-bit hashes by numpy over the bytes as Arrow holds them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Words longer than this are hashed one by one.
LONG = 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    """A 64-bit finish of x, another one for each k."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((k + 1) * _BASES[0] & (1 << 64) - 1)
        x ^= x >> np.uint64(30)
        x *= np.uint64(_MULTIPLIERS[0])
        x ^= x >> np.uint64(27)
        x *= np.uint64(_MULTIPLIERS[1])
        x ^= x >> np.uint64(31)
        return x


@dataclass
class Words:
    """Words of consecutive texts: hash of each, the number of the first word of each text (and their count), and the
    bytes (lower-cased if asked for) with where each word begins and ends in them."""

    hashes: np.ndarray
    edges: np.ndarray
    data: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.edges)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each text begins and the last one ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """The words of every text of a column without nulls; with lower, A-Z count as a-z."""
    if not len(column):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint8), none, none)
    data, at = _bytes_of(column)
    n = len(data)
    padded = np.zeros(n + LONG + 8, np.uint8)
    padded[:n] = _LOWER[data] if lower else data
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sizes = last - first
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def piece(starts, left):
        return np.ascontiguousarray(eights[starts]).view("<u8").ravel() & _MASKS[np.minimum(left, 8)]

    with np.errstate(over="ignore"):
        h = mixed(piece(first, sizes) + sizes.astype(np.uint64) * np.uint64(_BASES[1]))
        for k in range(8, LONG, 8):
            more = np.flatnonzero(sizes > k)
            if not len(more):
                break
            h[more] = mixed(h[more] ^ piece(first[more] + k, sizes[more] - k), 1)
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(padded[first[i] : last[i]].tobytes())
    return Words(h, np.searchsorted(first, at).astype(np.int64), padded, first, last)


def runs(h: np.ndarray, size: int, k: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `size` hashes (those over the end of a text included), another one for each k.

    A rolling polynomial modulo 2^64, built by doubling: hashes of 2, 4, 8 words are made of two halves each."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    base = _BASES[k % 2] + 2 * (k // 2)
    power = lambda e: np.uint64(pow(base, e, 1 << 64))
    with np.errstate(over="ignore"):
        have, out, done = 1, None, 0
        now, left = mixed(h, k), size
        while True:
            if left & 1:
                if out is None:
                    out, done = now, have
                else:  # `out` covers the first `done` words, `now` the next `have`
                    m = len(h) - done - have + 1
                    out, done = out[:m] * power(have) + now[done : done + m], done + have
            left >>= 1
            if not left:
                break
            now = now[:-have] * power(have) + now[have:]
            have *= 2
    return mixed(out[:n], 2 + k)


def whole_runs(words: Words, size: int) -> np.ndarray:
    """Places (numbers of the first word) of the runs of `size` words that lie within one text."""
    n = len(words.hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    # a text's last size - 1 words begin no run within it
    for k in range(1, size):
        at = words.edges[1:] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return np.flatnonzero(ok)


def slices(column: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive texts that hold about max_bytes together, one text at least."""
    _, at = _bytes_of(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + max_bytes, "right")) - 1)
        yield first, min(end, len(column))
        first = min(end, len(column))
