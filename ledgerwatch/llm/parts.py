"""Parts of texts between which no pre-token, merge or piece reaches: the unit that tokenizers are asked for once.

A part begins with its text, or at a space behind a character that is no white space; a text's last byte begins none. Patterns
that take one leading space into a word, and pieces that hold a space mark at their begin only, never cross such a place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .text import buffer_of, strings, whole

SPACES3 = np.zeros(256, bool)
SPACES3[[0x9A, 0x80, 0x81]] = True  # second bytes of the white space among three-byte characters
LEAD3 = np.zeros(256, bool)
LEAD3[[0xE1, 0xE2, 0xE3]] = True


def part_starts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts begin in texts flat[offsets[j]:offsets[j + 1]] of UTF-8."""
    at = np.flatnonzero(flat[2:] == 0x20) + 2 if len(flat) > 2 else np.zeros(0, np.int64)
    before, second, third = flat[at - 1], flat[at - 2], flat[np.maximum(at - 3, 0)]
    # Some characters beside white space end like it: then the part just goes on.
    open_ = (before <= 0x20) | (before == 0x7F) | ((second == 0xC2) & ((before == 0x85) | (before == 0xA0))) | (LEAD3[third] & SPACES3[second])
    at = at[~open_]
    begins = np.zeros(len(flat) + 1, bool)
    begins[at] = True
    some = np.diff(offsets) > 0
    begins[offsets[1:][some] - 1] = False  # a lone space at the end
    begins[offsets[:-1][some]] = True
    return np.flatnonzero(begins[:-1])


def parts_of(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The parts of all texts, as indices into the distinct ones, and the first part of every text (one more behind)."""
    flat, offsets = buffer_of(whole(texts))
    at = part_starts(flat, offsets)
    found = strings(flat, np.append(at, len(flat))).dictionary_encode()
    return found, np.searchsorted(at, offsets)


class Ragged:
    """Growing lists of numbers: entry k is flat[first[k]:first[k + 1]]."""

    def __init__(self, kind=np.int32):
        self.flat, self.first, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Appends len(sizes) entries."""
        end = int(self.first[self.n])
        while end + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.flat[end : end + len(values)] = values
        self.first[self.n + 1 : self.n + len(sizes) + 1] = end + np.cumsum(sizes)
        self.n += len(sizes)

    def sizes(self, k: np.ndarray) -> np.ndarray:
        return self.first[k + 1] - self.first[k]

    def start(self, k: np.ndarray) -> np.ndarray:
        return self.first[k]
