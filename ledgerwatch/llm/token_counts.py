"""Token counts of a byte-level BPE vocabulary, by rank-synchronous merging of arrays.

A text is cut at white space, which no token crosses; the distinct parts of a batch go through the vocabulary file's
own steps (special strings, NFC, lower case, pattern) into pre-tokens. All new pre-tokens are held as one ragged
array of symbols. In each round every sequence finds its pair of lowest rank and merges all its occurrences from left to
right, all sequences at once; a sequence is done when no pair of it has a rank. Counts are the symbols left.

Defined results: null and empty texts have 0 bytes and 0 tokens. Order and repetition of rows don't matter.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tables import free_name
from .text import SPACE, buffer_of, slices, strings, sums_by, whole

NEVER = np.iinfo(np.int64).max
REMEMBERED = 500_000  # parts that a task keeps between batches


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    printing = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merge ranks and text steps of a tokenizer file; refuses files with other steps than the ones built here."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        bpe, steps = spec["model"], spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        known = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}
        known &= split["behavior"] == "Removed" and split["invert"] and level["type"] == "ByteLevel" and not level["add_prefix_space"]
        if not known or bpe["type"] != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: steps that are not built here")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        vocab = bpe["vocab"]
        suffix = bpe["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in bpe["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.forget()

    def forget(self) -> None:
        self.lengths: dict[str, int] = {}  # symbols left of pre-tokens
        self.known: dict[str, int] = {}  # tokens of parts

    def merged_lengths(self, words: list[str]) -> np.ndarray:
        """Symbols left of each pre-token."""
        flat, offsets = buffer_of(pa.array(words, pa.large_string()))
        size = np.diff(offsets)
        symbols = self.inner[flat]
        symbols[offsets[1:] - 1] = self.final[flat[offsets[1:] - 1]]
        left = np.zeros(len(words), np.int64)
        row = np.repeat(np.arange(len(words)), size)
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[place] == key) & (row[:-1] == row[1:]), self.ranks[place], NEVER)
            rank = np.append(rank, NEVER)
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            lowest = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(row)))
            done = lowest == NEVER
            left[row[begin[done]]] = size[done]
            hit = (rank == np.repeat(lowest, size)) & (rank != NEVER)
            # A run of overlapping equal pairs merges every other one, from the left.
            at = np.flatnonzero(hit)
            run = np.cumsum(np.append(True, np.diff(at) > 1)) if len(at) else at
            first = at[np.searchsorted(run, run)] if len(at) else at
            at = at[(at - first) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.merged[place[at]]
            keep = np.repeat(~done, size)
            keep[at + 1] = False
            symbols, row = symbols[keep], row[keep]
        return left

    def pre_tokens(self, part: str) -> list[str]:
        text = unicodedata.normalize("NFC", part)
        # Lower case goes by character, without the rule for a final sigma.
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self.pattern.findall(text)

    def counts(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part."""
        new = [p for p in parts if p not in self.known]
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new = parts
            split: list[tuple[str, int, list[str]]] = []
            for p in new:
                n = len(self.special.findall(p)) if self.special and "<" in p else 0
                texts = self.special.split(p) if n else [p]
                split.append((p, n, [w for t in texts for w in self.pre_tokens(t)]))
            fresh = list(dict.fromkeys(w for _, _, words in split for w in words if w not in self.lengths))
            if fresh:
                self.lengths.update(zip(fresh, self.merged_lengths(fresh).tolist()))
            for p, n, words in split:
                self.known[p] = n + sum(map(self.lengths.__getitem__, words))
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_counts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of every text."""
    texts = whole(texts)
    flat, offsets = buffer_of(texts)
    solid = ~SPACE[flat]
    begin = np.zeros(len(flat), bool)
    begin[1:] = solid[1:] & ~solid[:-1]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True  # a part: a run of white space or nothing, then a word
    at = np.flatnonzero(begin)
    parts = strings(flat, np.append(at, len(flat))).dictionary_encode()
    counts = vocabulary(path).counts(parts.dictionary.to_pylist())
    per_part = counts[parts.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64)
    return np.diff(offsets), sums_by(per_part, np.searchsorted(at, offsets))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    base = docs.select(*[f"`{c}`" for c in keep])
    names = [free_name(base, c) for c in ("n_bytes", "n_tokens", "over_limit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                size, tokens = token_counts(part.column("text"), path)
                arrays = [part.column(c) for c in keep] + [pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])
        vocabulary(path).forget()  # Spark keeps the process for other tasks

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{c}` {k}" for c, k in zip(names, ("bigint", "bigint", "boolean"))])
    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "text"])]).mapInArrow(run, schema)
