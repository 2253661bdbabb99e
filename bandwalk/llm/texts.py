"""Words and hashes of Arrow text columns, computed on the raw bytes with numpy.

A word is a run of bytes other than space and 0x09-0x0D. All functions work on one
slice of a batch at a time; ``slices`` keeps a slice near a byte budget, so memory
does not follow the batch size (one longer text makes a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
LONG_WORD = 48

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``budget`` text bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + budget, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the column and the n + 1 bounds of its texts; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


class Words:
    """Word table of a slice: start and end byte, 64-bit hash, first word of each text."""

    def __init__(self, column: pa.Array):
        self.data, self.bounds = raw(column)
        data, n = self.data, len(column)
        blank = SPACE[data]
        first, last = ~blank, ~blank
        if len(data):
            first[1:] &= blank[:-1]
            last[:-1] &= blank[1:]
            filled = self.bounds[:-1] < self.bounds[1:]
            starts, ends = self.bounds[:-1][filled], self.bounds[1:][filled] - 1
            first[starts] = ~blank[starts]
            last[ends] = ~blank[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, self.bounds)  # words of text i: of[i] to of[i + 1]
        self.count = np.diff(self.of)
        self.text = np.repeat(np.arange(n), self.count)

    def hashes(self) -> np.ndarray:
        size = self.end - self.start
        h = np.full(len(size), 7, np.uint64) + size.astype(np.uint64)
        active = np.arange(len(size))
        for j in range(min(int(size.max(initial=0)), LONG_WORD)):
            active = active[size[active] > j]
            h[active] = (h[active] ^ self.data[self.start[active] + j]) * _P
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return mix(h)


def shingles(words: Words, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of n words, h being the words' hashes; a text with fewer words is one run."""
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    factor = np.uint64(1)
    for j in range(n):
        factor = np.uint64((int(factor) * int(_P) + 0x51) & (2**64 - 1))
        total += h[j : len(h) - n + 1 + j] * factor
    count = words.count
    whole = np.maximum(count - n + 1, 0)
    text = np.repeat(np.arange(len(count)), whole)
    before = np.cumsum(whole) - whole
    at = np.arange(len(text)) - np.repeat(before, whole) + np.repeat(words.of[:-1], whole)
    out = mix(total[at])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        short_hash = np.zeros(len(short), np.uint64)
        for j in range(n):
            has = count[short] > j
            short_hash[has] = mix(short_hash[has] ^ h[words.of[short[has]] + j]) + _P
        text, out = np.concatenate([text, short]), np.concatenate([out, short_hash])
    return text, out


def occurrences(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs ordered so that equal ones stand together, and how many equal ones stand before each."""
    key = mix(value ^ mix(text.astype(np.uint64) + _P))
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return text[order], value[order], nth
