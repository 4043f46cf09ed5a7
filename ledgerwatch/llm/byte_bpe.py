"""Byte-level BPE by merge ranks, encoded and decoded by DuckDB queries inside each task.

Texts are cut into matches of the vocabulary's pattern; the distinct matches of a task are merged once. A recursive query holds
their tokens as rows of word and position: in each turn the rows join the table of merges on a token and its successor, and every
word contracts its leftmost pair of lowest rank, until no word has a pair with a rank. Decoding joins the rows of row, position
and id with the vocabulary and puts their bytes together by an ordered aggregation. Both databases live in the memory of the
task, with one thread and a bound on memory; Spark deals the rows.

One contraction a turn costs the square of a word's length, so matches beyond ``LONG`` bytes (a wall of letters or of white
space) are contracted in the same order with a heap.

Defined results: null texts encode like empty ones, into no ids; null ids decode to null. An id that the vocabulary doesn't have
is an error. Order and repetition of rows don't matter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .parts import Ragged, parts_of
from .tables import column, free_name
from .text import ragged, slices

LONG = 256  # bytes of a match that the query takes
SLICE = 4 << 20  # bytes of texts that are encoded together
WORDS = 30_000  # matches that one query holds
TOKENS = 1 << 18  # ids that one decoding query holds
REMEMBERED = 1 << 27  # bytes of matches and ids that a task keeps between batches
POSITION = 24  # bits of a position below the rank

MERGED = f"""
WITH RECURSIVE state(turn, word, ids) AS (
  SELECT 0::INTEGER, word, ids FROM started
  UNION ALL
  SELECT turn + 1, state.word, list_concat(ids[:(low & {(1 << POSITION) - 1}) - 1], [(low >> {POSITION})::INTEGER], ids[(low & {(1 << POSITION) - 1}) + 2:])
  FROM state JOIN (
    SELECT word, min(merged << {POSITION} | place) AS low FROM (
      SELECT word, unnest(ids)::BIGINT << 32 | unnest(ids[2:]) AS pair, unnest(range(1, len(ids) + 1)) AS place FROM state
    ) JOIN merges USING (pair) GROUP BY word
  ) AS lowest ON state.word = lowest.word
)
SELECT arg_max(ids, turn) AS ids FROM state GROUP BY word ORDER BY word
"""

DECODED = """
SELECT row, unhex(string_agg(hex, '' ORDER BY place)) AS bytes, count(*) AS n FROM tokens JOIN vocabulary USING (id) GROUP BY row ORDER BY row
"""


def database() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


class Ranks:
    """A file of merge ranks, which are the ids as well, and what a task has encoded by it so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        token = self.ranks
        merges = [(token[t[:i]] << 32 | token[t[i:]], r) for t, r in token.items() for i in range(1, len(t)) if t[:i] in token and t[i:] in token]
        self.con = database()
        self.fill("merges", pa.table({"pair": pa.array([p for p, _ in merges], pa.int64()), "merged": pa.array([r for _, r in merges], pa.int64())}))
        self.fill("vocabulary", pa.table({"id": pa.array(list(token.values()), pa.int32()), "hex": pa.array([t.hex() for t in token], pa.string())}))
        self.forget()

    def fill(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def forget(self) -> None:
        self.words, self.word_ids = {}, Ragged()
        self.parts, self.part_ids = {}, Ragged()
        self.held = 0

    def merged(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and numbers of ids of the words, by the recursive query."""
        for at in range(0, len(words), WORDS):
            some = words[at : at + WORDS]
            flat = np.frombuffer(b"".join(some), np.uint8)
            offsets = np.cumsum([0, *map(len, some)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.single[flat], pa.int32()))
            self.con.register("started", pa.table({"word": pa.array(np.arange(len(some)), pa.int32()), "ids": ids}))
            found = self.con.sql(MERGED).to_arrow_table().column("ids").combine_chunks()
            self.con.unregister("started")
            yield found.flatten().to_numpy(), found.value_lengths().to_numpy()

    def contracted(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the same contractions in the same order, from a heap of (rank, place)."""
        n, token = len(word), self.ranks
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        rank = lambda i: token.get(word[i : end[after[i]]]) if after[i] < n else None
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop or token.get(word[i:stop]) != r:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
        return np.array([token[word[i : end[i]]] for i in range(n) if alive[i]], np.int32)

    def learn(self, words: list[str]) -> None:
        """Ids of new matches."""
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]) > LONG)
        self.words.update(zip([words[i] for i in order], range(self.word_ids.n, self.word_ids.n + len(words))))
        for ids, sizes in self.merged([raw[i] for i in order if len(raw[i]) <= LONG]):
            self.word_ids.add(ids, sizes)
        for i in order:
            if len(raw[i]) > LONG:
                ids = self.contracted(raw[i])
                self.word_ids.add(ids, np.array([len(ids)]))
        self.held += sum(map(len, raw)) + 100 * len(raw)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more behind)."""
        found, first = parts_of(texts)
        distinct = found.dictionary.to_pylist()
        if self.held > REMEMBERED:
            self.forget()
        new = [p for p in distinct if p not in self.parts]
        if new:
            cut = [self.pattern.findall(p) for p in new]
            fresh = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self.words]
            if fresh:
                self.learn(fresh)
            counts = np.fromiter(map(len, cut), np.int64, len(cut))
            word = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
            sizes = self.word_ids.sizes(word)
            ids = self.word_ids.flat[ragged(self.word_ids.start(word), sizes)]
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
            self.parts.update(zip(new, range(self.part_ids.n, self.part_ids.n + len(new))))
            self.part_ids.add(ids, np.diff(np.append(0, ends)))
            self.held += 4 * len(ids) + sum(map(len, new)) + 100 * len(new)
        number = np.fromiter(map(self.parts.__getitem__, distinct), np.int64, len(distinct))
        part = number[found.indices.to_numpy(zero_copy_only=False)]
        sizes = self.part_ids.sizes(part)
        ids = self.part_ids.flat[ragged(self.part_ids.start(part), sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Bytes of the rows ids[first[j]:first[j + 1]]."""
        out, at, rows = [], 0, len(first) - 1
        while at < rows:
            to = max(at + 1, int(np.searchsorted(first, first[at] + TOKENS, side="right")) - 1)
            some, size = ids[first[at] : first[to]], np.diff(first[at : to + 1])
            self.con.register("tokens", pa.table({
                "row": pa.array(np.repeat(np.arange(to - at), size), pa.int32()), "place": pa.array(np.arange(len(some)), pa.int32()), "id": pa.array(some, pa.int32())}))
            found = self.con.sql(DECODED).to_arrow_table()
            self.con.unregister("tokens")
            if sum(found.column("n").to_pylist()) != len(some):
                raise ValueError("an id is not in the vocabulary")
            plain = [b""] * (to - at)
            for row, data in zip(found.column("row").to_pylist(), found.column("bytes").to_pylist()):
                plain[row] = data
            out += plain
            at = to
        return out


@lru_cache(maxsize=4)
def ranks_of(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids``, the text's ids in order."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    ids = free_name(docs.select(*map(column, keep)), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flat, first = ranks.encode(part.column("text"))
                found = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), found], names=[*keep, ids])
        ranks.forget()  # Spark keeps the process for other tasks

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{ids}` array<int>"])
    return docs.select(*map(column, dict.fromkeys([*keep, "text"]))).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``rows`` and ``decoded``, the bytes that the ids of a row stand for."""
    decoded = free_name(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path, pattern)
        for batch in batches:
            size = batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            total, at = np.cumsum(size), 0
            while at < batch.num_rows:  # runs of rows with about TOKENS ids together; a longer row is a run of its own
                to = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + TOKENS, side="right")))
                part = batch.slice(at, to - at)
                given = part.column(ids)
                flat = given.flatten().cast(pa.int32())
                if flat.null_count:
                    raise ValueError("a null is not in the vocabulary")
                plain = ranks.decode(flat.to_numpy(), np.concatenate([[0], np.cumsum(size[at:to])]))
                yield part.append_column(decoded, pa.array([p if k else None for p, k in zip(plain, given.is_valid().to_pylist())], pa.binary()))
                at = to

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{decoded}` binary"])
    return rows.mapInArrow(run, schema)
