"""Array kernels over Arrow text columns: words, hashes and n-grams of many texts at once.

A slice of a column is one byte array with the texts' bounds; every step is a
numpy pass over it, so no Python code runs for single words. Slices are cut at
text bounds when they reach ``SLICE`` bytes; only a text that is itself longer
makes a longer one. A worker's peak is up to about 150 times the slice, so it
is kept small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 19

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit words."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit words that look random."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x51_7CC1B7_2722)) | U(1)


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    return constants(1, 256)


_places = constants(2, 4096)


def _place_table(n: int) -> np.ndarray:
    global _places
    if len(_places) < n:
        _places = constants(2, 2 * n)
    return _places


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds): the UTF-8 bytes of consecutive texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def word_bounds(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, per text: number of its first word; one more entry with the total) of the words in a slice."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(space[data], out=inside[1:-1])
    first = inside[1:] & ~inside[:-1]  # a word starts at byte i, or one ended before it
    last = inside[:-1] & ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # texts that meet without white space between them
    first[cuts] = True
    last[cuts] = True
    start, end = np.flatnonzero(first[: len(data)]), np.flatnonzero(last)
    return start, end, np.searchsorted(start, bounds)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, dtype=U)
    lengths = end - start
    total = int(lengths.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    at = np.arange(total) + shift
    place = at - np.repeat(start, lengths)
    parts = _byte_table()[data[at]] * _place_table(int(lengths.max()))[place]
    return mix(np.add.reduceat(parts, np.concatenate(([0], np.cumsum(lengths)[:-1]))))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds per text) of the runs of k words of each text; fewer words, but not none, are one run."""
    counts = np.diff(first)
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(runs)))
    weights = constants(3, k)
    out = np.zeros(int(bounds[-1]), dtype=U)
    text = np.repeat(np.arange(len(counts)), runs)
    at = first[:-1][text] + (np.arange(len(out)) - bounds[:-1][text])
    short = (counts < k)[text]
    full, brief = np.flatnonzero(~short), np.flatnonzero(short)
    acc = np.zeros(len(full), dtype=U)
    for j in range(k):
        acc += words[at[full] + j] * weights[j]
    out[full] = acc
    for i in brief:
        n = int(counts[text[i]])
        w = words[at[i] : at[i] + n]
        out[i] = np.append(w * weights[:n], U(0x9E3779B97F4A7C15 * n % 2**64)).sum(dtype=U)
    return mix(out), bounds


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment sorted, without repetitions; (values, new bounds)."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    if len(values):
        keep[1:] = values[1:] != values[:-1]
        starts = bounds[:-1]
        keep[starts[starts < len(values)]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], kept[bounds]


class Table:
    """Sorted 64-bit keys with a start for each leading part, for many lookups."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(U))
        self.bits = max(4, min(22, len(keys).bit_length() + 1))
        top = (self.keys >> U(64 - self.bits)).astype(np.int64)
        self.starts = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.starts).max()) if len(self.keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        top = (keys >> U(64 - self.bits)).astype(np.int64)
        at, end = self.starts[top], self.starts[top + 1]
        rest = np.flatnonzero(at < end)
        at, end = at[rest].astype(np.int64), end[rest]
        for _ in range(self.longest):
            if not len(rest):
                break
            same = self.keys[at] == keys[rest]
            out[rest[same]] = at[same]
            at += 1
            more = ~same & (at < end)
            rest, at, end = rest[more], at[more], end[more]
        return out
