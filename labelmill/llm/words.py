"""Words and word windows of Arrow text columns as 64-bit hashes.

Texts stay in Arrow's contiguous UTF-8 buffer; words, windows and their hashes are numpy
arrays over it, so no Python object is made per word. Hashes are 64 bits wide: two
different windows of n in all collide with probability n**2 / 2**65.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of whole texts that are worked on at once, and of their words that are hashed at
#: once (about 50 bytes of memory each, which fit a processor's cache); both bound the
#: memory of a task.
SLICE_BYTES, HASH_BYTES = 4 << 20, 1 << 17

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits (the SplitMix64 finalizer)."""
    x = np.asarray(x, U) + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(256))
STEP = mix(np.arange(1000, 1001)) | U(1)  # base of the window polynomial, odd


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z; every other byte stays."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text begins and the end); nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``limit`` bytes of text each."""
    _, offsets = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


@dataclass
class Words:
    """Words of some texts, in order. ``first[d]`` is the index of text d's first word."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """A hash of each word. Bytes up to the next word are separators and add nothing."""
    byte = np.where(separators, U(0), BYTE)
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + HASH_BYTES, "right")))
        begin = start[i:j] - start[i]
        reach = int(end[j - 1] - start[i])
        span = np.diff(begin, append=reach)
        pos = np.arange(reach) - np.repeat(begin, span)
        key = mix(np.arange(int(span.max())) + 7_000_000) | U(1)
        part = byte[buf[start[i] : end[j - 1]]]
        part *= key[pos]
        out[i:j] = np.add.reduceat(part, begin) + (end[i:j] - start[i:j]).astype(U)
        i = j
    return mix(out)


def words(column: pa.Array, lower: bool = False, separators: np.ndarray = SPACE) -> Words:
    """Words are the maximal runs of bytes outside ``separators``; they never span texts."""
    buf, offsets = text_bytes(column)
    if lower:
        buf = ascii_lower(buf)
    inside = ~separators[buf]
    fresh = np.ones(len(buf), bool)
    fresh[1:] = ~inside[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(buf)]] = True
    start = np.flatnonzero(inside & fresh)
    last = np.ones(len(buf), bool)
    last[:-1] = ~inside[1:] | fresh[1:]
    end = np.flatnonzero(inside & last) + 1
    return Words(buf, start, end, np.searchsorted(start, offsets), _hash_words(buf, start, end, separators) if len(start) else np.zeros(0, U))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries; runs may span texts."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, U)
    power = np.ones(n + 1, U)
    power[1:] = STEP[0]
    power = np.multiply.accumulate(power)
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * power[:-1], out=sums[1:])
    inverse = U(pow(int(STEP[0]), -1, 1 << 64))
    back = np.full(n - size + 1, inverse, U)
    back[0] = 1
    return mix((sums[size:] - sums[:-size]) * np.multiply.accumulate(back) + U(size))


def whole(hashes: np.ndarray) -> int:
    """Hash of all entries as one window."""
    return int(windows(hashes, len(hashes))[0])


def moving(values: np.ndarray, width: int, fn) -> np.ndarray:
    """fn (np.minimum or np.maximum) over every run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = fn(out[:-step], out[step:])
        have += step
    return out


def spread(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """A block number from 0 for each hash, by its top 24 bits."""
    return (((hashes >> U(40)) * U(blocks)) >> U(24)).astype(np.int64)


def packed(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """values[bounds[i]:bounds[i+1]] as bytes, for each i."""
    return [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
