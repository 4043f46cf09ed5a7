"""Whole texts as numpy arrays: words, word hashes and ragged gathers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. None of those bytes occurs inside a multi-byte
UTF-8 character, so work on bytes equals work on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def u64(value: int) -> np.uint64:
    return np.uint64(value & MASK)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, in which every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= u64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= u64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the sequences (a, b)."""
    return mixed(a * u64(0xD6E8FEB86659FD93) + b + u64(BASE))


LOW = 1 << 15


def _powers_of(base: int, n: int) -> np.ndarray:
    table = np.full(n, u64(base))
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


INVERSE = pow(BASE, -1, 1 << 64)
_low, _inverse_low = _powers_of(BASE, LOW), _powers_of(INVERSE, LOW)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base, modulo 2^64."""
    high = _powers_of(pow(BASE, LOW, 1 << 64), -(-n // LOW) or 1)
    return (high[:, None] * _low).ravel()[:n]


def inverse_powers(at: np.ndarray) -> np.ndarray:
    """Powers of the base's inverse with the exponents ``at``."""
    high = _powers_of(pow(INVERSE, LOW, 1 << 64), int(at.max(initial=0)) // LOW + 1)
    return high[at // LOW] * _inverse_low[at % LOW]


@dataclass
class Words:
    """Words of some texts. ``flat`` holds every word followed by one space; word i is flat[start[i]:end[i]];
    text j has the words first[j] to first[j + 1]."""

    flat: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def byte_sums(self) -> np.ndarray:
        """Running polynomial sums of the bytes, for span hashes."""
        sums = np.zeros(len(self.flat) + 1, np.uint64)
        np.multiply(self.flat, powers(len(self.flat)), out=sums[1:])
        np.cumsum(sums, out=sums)
        return sums

    def span_hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * inverse_powers(start) + (end - start).astype(np.uint64) * u64(0xA0761D6478BD642F))


def words_of(flat: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of texts that each end in white space: text j is flat[offsets[j]:offsets[j + 1]]."""
    space = SPACE[flat]
    after = np.zeros(len(flat), bool)
    after[1:] = ~space[:-1]
    after &= space
    keep = ~space
    keep |= after
    raw_end = np.flatnonzero(after)
    flat = flat[keep]
    end = np.flatnonzero(after[keep])
    flat[end] = 0x20
    start = np.zeros(len(end), np.int64)
    start[1:] = end[:-1] + 1
    return Words(flat, start, end, np.searchsorted(raw_end, offsets))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of texts without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def whole(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks]) if texts.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(texts.cast(pa.large_string()), "")


def words_in(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    texts = whole(texts)
    empty = pa.scalar("", pa.large_string())
    flat, offsets = buffer_of(pc.binary_join_element_wise(texts, empty, pa.scalar("\n", pa.large_string())))
    return words_of(LOWER[flat] if lower else flat.copy(), offsets)


def slices(table: pa.Table | pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.Table | pa.RecordBatch]:
    """Runs of rows whose texts have about ``size`` bytes together; a longer text is a run of its own."""
    if not table.num_rows:
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < table.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + size, side="right")))
        yield table.slice(at, to - at)
        at = to


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 of all i, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)


def strings(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over bytes; text j is flat[offsets[j]:offsets[j + 1]]."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(flat)))


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[j]:first[j + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
