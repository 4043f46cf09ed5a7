"""Alignment of two tokenizers over the same bytes, from the spans that their libraries give.

Both see a space and then the text: tokenizer A as it is, B by the space mark that it puts in front. A's character offsets
and B's proto spans are the coarse cuts. They are no byte ends where several tokens of A lie in one character, and for B's
byte-fallback pieces; there, the lengths of the decoded bytes refine them. Byte ends common to A and B cut both into groups, and
all tokens of a group are linked.

A text falls into parts that neither tokenizer crosses (``parts``), so the libraries see each distinct part of a task once, and
groups, links and texts of parts put those of documents together. Documents travel in chunks: a chunk sends each
pair of ids that it links once, with the number of its documents, to the bucket of the A id; the bucket sums, finds
each A id's highest count, and answers the chunks. A pair that every document holds is one entry per chunk.

Defined results: null and empty texts, and texts whose joined bytes of A or B differ from space + text (a literal U+2581,
say), have no tokens: zeros and an empty ``groups``. Rows with one id are documents of their own. Order of rows doesn't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .packed import joined, pack, unpack
from .parts import Ragged, parts_of
from .tables import column, free_name, shuffle_width
from .text import mixed, ragged, slices, sums_by, u64, whole
from .token_counts import byte_symbols

MARK = "▁"
CHUNK = 6 << 20  # bytes of text
KEYS = 4 << 20  # pairs of a chunk per bucket
REMEMBERED = 5 << 24  # bytes of parts and links that a task keeps between batches
LEARNED = 10_000  # parts that the libraries get at once
TEXT = 2000  # bytes of parts in one text
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def flattened(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum(size)])


class Pair:
    """Both tokenizers, the bytes of their ids, and what a task has aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(byte_symbols())}
        with open(path_a, encoding="utf-8") as file:
            special = {t["content"] for t in json.load(file)["added_tokens"]}
        plain = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            plain[i] = token.encode() if token in special else bytes(map(byte_of.__getitem__, token))
        self.a_flat, self.a_first = flattened(plain)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.fallback = np.array([self.b.is_byte(i) for i in range(n)])
        odd = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p, o in zip(pieces, odd) if not o):
            raise ValueError("a piece holds a space mark after another character")
        self.b_flat, self.b_first = flattened(
            [b"" if o else bytes([int(p[1:-1], 16)]) if f else p.replace(MARK, " ").encode() for p, o, f in zip(pieces, odd, self.fallback)])
        self.decimal = np.array([str(i) for i in range(max(n, len(plain)))], object)
        self.forget()

    def forget(self) -> None:
        self.parts: dict[str, int] = {}
        self.keys, self.times = Ragged(np.int64), Ragged(np.int32)
        self.counts = Ragged(np.int64)  # COUNTS and 1 if the bytes are right, per part
        self.texts: list[str] = []
        self.held = 0

    def tokens(self, parts: list[str]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray]:
        """``spans`` of parts, which go to the libraries many in one text: a part that ends in a letter or sign doesn't touch
        the next one. Where the bytes of such a text aren't right, its parts go one by one."""
        size = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
        offsets = np.concatenate([[0], np.cumsum(size)])
        first, held = [], TEXT
        for i, part in enumerate(parts):
            if held >= TEXT:
                first.append(i)
                held = 0
            held = held + int(size[i]) if "!" <= part[-1] <= "~" or "À" <= part[-1] <= "ÿ" else TEXT
        cuts = np.append(first, len(parts))
        *sides, right = self.spans(["".join(parts[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
        alone = np.repeat(~right & (np.diff(cuts) > 1), np.diff(cuts))
        out = []
        for id_, text, end in sides:
            at = offsets[cuts[text]] + end
            part = np.searchsorted(offsets, at) - 1
            keep = right[text]
            out.append((id_[keep], part[keep], (at - offsets[part])[keep]))
        right = np.repeat(right, np.diff(cuts))
        if alone.any():
            own = np.flatnonzero(alone)
            *sides, right[own] = self.spans([parts[i] for i in own.tolist()])
            for k, (id_, part, end) in enumerate(sides):
                more = [np.concatenate(v) for v in zip(out[k], (id_, own[part], end))]
                order = np.argsort(more[1], kind="stable")
                out[k] = tuple(v[order] for v in more)
        return out[0], out[1], right

    def spans(self, parts: list[str]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray]:
        """(id, part, byte end in its part) of A's and of B's tokens, and whether a part's joined bytes are right."""
        flat, offsets = flattened([p.encode() for p in parts])
        size = np.diff(offsets)
        n = len(parts)

        found = self.a.encode_batch(parts, add_special_tokens=False)
        per = np.fromiter(map(len, found), np.int64, n)
        a_id = np.fromiter(chain.from_iterable(e.ids for e in found), np.int64, int(per.sum()))
        span = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64, 2 * len(a_id)).reshape(-1, 2)
        a_part = np.repeat(np.arange(n), per)
        starts = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))  # bytes at which characters begin
        chars = np.searchsorted(starts, offsets)
        a_end = starts[chars[a_part] + span[:, 1]] - offsets[a_part]
        shared = np.append((span[1:, 0] < span[:-1, 1]) & (a_part[1:] == a_part[:-1]), False)  # the character goes on in the next token
        a_end = np.where(shared, self.exact(a_id, per, self.a_first), a_end)

        found = self.b.encode([p[1:] for p in parts], return_type="proto", num_threads=1)
        per = np.fromiter((len(e.pieces) for e in found), np.int64, n)
        pieces = [p for e in found for p in e.pieces]
        b_id, end = (np.fromiter(map(attrgetter(c), pieces), np.int64, len(pieces)) for c in ("id", "end"))
        b_part = np.repeat(np.arange(n), per)
        b_end = np.where(self.fallback[b_id], self.exact(b_id, per, self.b_first), end + 1)  # behind the space in front

        right = np.ones(n, bool)
        for id_, part, data, first in ((a_id, a_part, self.a_flat, self.a_first), (b_id, b_part, self.b_flat, self.b_first)):
            length = first[id_ + 1] - first[id_]
            right &= np.bincount(part, weights=length, minlength=n).astype(np.int64) == size
            some = right[part]
            own = data[ragged(first[id_[some]], length[some])]
            place = ragged(offsets[:-1][right], size[right])
            right[np.repeat(np.flatnonzero(right), size[right])[own != flat[place]]] = False
        return (a_id, a_part, a_end), (b_id, b_part, b_end), right

    @staticmethod
    def exact(id_: np.ndarray, per: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Byte ends of tokens in their parts by the lengths of their decoded bytes."""
        total = np.cumsum(first[id_ + 1] - first[id_])
        before = np.concatenate([[0], total])[np.cumsum(per) - per]
        return total - np.repeat(before, per)

    def learn(self, parts: list[str]) -> None:
        (a_id, a_part, a_end), (b_id, b_part, b_end), right = self.tokens(parts)
        n = len(parts)
        a, b = right[a_part], right[b_part]
        a_id, a_part, a_end, b_id, b_part, b_end = a_id[a], a_part[a], a_end[a], b_id[b], b_part[b], b_end[b]
        a_at, b_at = a_part << 32 | a_end, b_part << 32 | b_end
        common = np.intersect1d(a_at, b_at, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_at), np.searchsorted(common, b_at)
        of_group = common >> 32
        in_a, in_b = (np.bincount(g, minlength=len(common)) for g in (a_group, b_group))
        sums = lambda of, weights=None: np.bincount(of, weights, n).astype(np.int64)
        counts = np.stack([sums(a_part), sums(b_part), sums(of_group), sums(of_group, in_a * in_b), right.astype(np.int64)], 1)
        # Distinct ids of each group, then their pairs; a repeated id counts as often as it is there.
        (ga, ia, ca), (gb, ib, cb) = (distinct(g, i) for g, i in ((a_group, a_id), (b_group, b_id)))
        first_b = np.searchsorted(gb, np.arange(len(common) + 1))
        size = np.diff(first_b)[ga]
        left, other = np.repeat(np.arange(len(ga)), size), ragged(first_b[ga], size)
        part = of_group[ga[left]]
        keys, times = ia[left] << 32 | ib[other], ca[left] * cb[other]
        order = np.lexsort((keys, part))
        keys, times, part = keys[order], times[order], part[order]
        head = np.append(True, (keys[1:] != keys[:-1]) | (part[1:] != part[:-1]))[: len(keys)]
        at = np.flatnonzero(head)
        times = np.add.reduceat(times, at) if len(at) else times
        sizes = np.bincount(part[at], minlength=n)
        self.keys.add(keys[at], sizes)
        self.times.add(times, sizes)
        self.counts.add(counts.ravel(), np.full(n, 5))
        # Texts: tokens by group, A's before B's, each with the sign behind it.
        group, side = np.concatenate([a_group, b_group]), np.repeat([0, 1], [len(a_id), len(b_id)])
        order = np.lexsort((side, group))
        group, side, token, owner = group[order], side[order], np.concatenate([a_id, b_id])[order], np.concatenate([a_part, b_part])[order]
        sign = np.append(np.where(group[1:] != group[:-1], ";", np.where(side[1:] != side[:-1], "|", ",")), ";")[: len(token)].astype(object)
        text = (self.decimal[token] + sign).tolist()
        cuts = np.searchsorted(owner, np.arange(n + 1)).tolist()
        self.texts += ["".join(text[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]  # each ends in ";"
        self.parts.update(zip(parts, range(len(self.parts), len(self.parts) + n)))
        self.held += 20 * len(keys) + len(token) * 8 + sum(map(len, parts)) + 250 * n

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of all texts, a space in front, and the first of each text (one more behind). Empty texts have none."""
        texts = whole(texts)
        some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        front = pa.array(np.where(some, " ", "").tolist(), pa.large_string())
        found, first = parts_of(pc.binary_join_element_wise(front, texts, pa.scalar("", pa.large_string())))
        distinct = found.dictionary.to_pylist()
        if self.held > REMEMBERED:
            self.forget()
        new = [p for p in distinct if p not in self.parts]
        for at in range(0, len(new), LEARNED):
            self.learn(new[at : at + LEARNED])
        number = np.fromiter(map(self.parts.__getitem__, distinct), np.int64, len(distinct))
        return number[found.indices.to_numpy(zero_copy_only=False)], first


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in rising order, and how often each is there; ``values`` is sorted."""
    values.sort()
    head = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[head], np.diff(np.append(head, len(values)))


def distinct(group: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts = counted(group << 32 | id_)
    return keys >> 32, keys & 0xFFFFFFFF, counts


@lru_cache(maxsize=2)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def packed_chunk(pair: Pair, texts: pa.Array, groups: str) -> dict[str, object]:
    """What a chunk keeps of its documents: counts and texts of groups, their distinct parts, the parts' links, and the
    distinct pairs with the number of documents that hold them."""
    number, first = pair.numbers(texts)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    values = pair.counts.flat.reshape(-1)[: 5 * pair.counts.n].reshape(-1, 5)[number]
    wrong = np.zeros(len(first) - 1, bool)
    wrong[of[values[:, 4] == 0]] = True
    values = np.where(wrong[of, None], 0, values)
    out: dict[str, object] = {c: sums_by(values[:, k], first) for k, c in enumerate(COUNTS)}
    known = number.tolist()
    shown = []
    for i, j, w in zip(first[:-1].tolist(), first[1:].tolist(), wrong.tolist()):
        text = "".join(map(pair.texts.__getitem__, known[i:j]))[:-1] if not w else ""
        shown.append(hashlib.sha256(text.encode()).hexdigest() if groups == "digest" and text else text)
    out["groups"] = shown
    keep = ~wrong[of]
    held, times = counted(of[keep] << 32 | number[keep])
    own = np.flatnonzero(np.bincount(held & 0xFFFFFFFF, minlength=1))[: len(held)]
    place = np.searchsorted(own, held & 0xFFFFFFFF)
    doc = held >> 32
    sizes = pair.keys.sizes(own)
    at = ragged(pair.keys.start(own), sizes)
    keys, link = np.unique(pair.keys.flat[at], return_inverse=True)
    # Documents of a pair: a document's parts may hold it several times.
    begin = np.cumsum(sizes) - sizes
    once = np.repeat(doc, sizes[place]) << 32 | link[ragged(begin[place], sizes[place])]
    once.sort()
    once = once[np.append(True, once[1:] != once[:-1])[: len(once)]]
    out |= {"parts": pack(place), "per_doc": pack(np.bincount(doc, minlength=len(first) - 1)), "times": pack(times),
            "links": pack(link), "per_part": pack(sizes), "weights": pack(pair.times.flat[at]),
            "keys": pack(keys, True), "docs": pack(np.bincount(once & 0xFFFFFFFF, minlength=len(keys))), "n_keys": len(keys)}
    return out


def chunked(docs: DataFrame, path_a: str, path_b: str, keep: tuple[str, ...], groups: str, size: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number, held, held_bytes = pair_of(path_a, path_b), TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal number, held, held_bytes
            table = pa.Table.from_batches(held).combine_chunks()
            found = packed_chunk(pair, table.column("text"), groups)
            listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            row = {"chunk": pa.array([number])}
            row |= {f"kept{i}": listed(table.column(c).combine_chunks()) for i, c in enumerate(keep)}
            row |= {c: listed(pa.array(found[c], pa.int64())) for c in COUNTS} | {"groups": listed(pa.array(found["groups"], pa.string()))}
            row |= {c: pa.array([found[c]], pa.binary()) for c in PACKED} | {"n_keys": pa.array([found["n_keys"]])}
            number, held, held_bytes = number + 1, [], 0
            return pa.record_batch(row)

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(part)
                held_bytes += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held_bytes >= size:
                    yield chunk()
        if held:
            yield chunk()
        pair.forget()  # Spark keeps the process for other tasks

    schema = ["chunk bigint", *(f"kept{i} array<{kinds[c]}>" for i, c in enumerate(keep)), *(f"{c} array<bigint>" for c in COUNTS),
              "groups array<string>", *(f"{c} binary" for c in PACKED), "n_keys bigint"]
    return cut_lineage(docs.select(*map(column, dict.fromkeys([*keep, "text"]))).mapInArrow(run, ", ".join(schema)))


PACKED = ("parts", "per_doc", "times", "links", "per_part", "weights", "keys", "docs")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """All pairs of an A id go to one bucket."""
    return (mixed((keys >> 32).astype(np.uint64)) % u64(buckets)).astype(np.int64)


def sent(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, docs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "keys", "docs"))):
                keys, docs = unpack(keys), unpack(docs)
                bucket = bucket_of(keys, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                rows = [(b, chunk, pack(keys[order[i:j]], True), pack(docs[order[i:j]])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                     names=["bucket", "chunk", "keys", "docs"])

    return chunks.select("chunk", "keys", "docs").mapInArrow(run, "bucket int, chunk bigint, keys binary, docs binary")


def tallied(table: pa.Table) -> pa.Table:
    """One bucket: for every chunk, each of its pairs' documents in the whole table, negative if its A id has a pair with more."""
    keys, sizes = joined(table.column("keys").to_pylist())
    found, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, joined(table.column("docs").to_pylist())[0])
    head = np.flatnonzero(np.append(True, found[1:] >> 32 != found[:-1] >> 32))
    most = np.repeat(np.maximum.reduceat(total, head), np.diff(np.append(head, len(found))))
    told = np.where(total == most, total, -total)[place]
    ends = np.cumsum(sizes)
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"),
                     "told": pa.array([pack(told[i:j]) for i, j in zip((ends - sizes).tolist(), ends.tolist())], pa.binary())})


def align(docs: DataFrame, path_a: str, path_b: str, keep: tuple[str, ...] = ("doc_id",), groups: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    groups: the ids of A and B, as in ``a1,a2|b1;a3|b2,b3``; or, with ``groups="digest"``, groups_sha256 of that text. A pair of ids counts in
    how many documents it is linked; n_best counts the links whose pair has the highest count of its A id, count_sum adds up the counts."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    base = docs.select(*map(column, keep))
    names = [free_name(base, c) for c in (*COUNTS, "n_best", "count_sum", "groups_sha256" if groups == "digest" else "groups")]
    chunks = chunked(docs, path_a, path_b, keep, groups, chunk)
    total = chunks.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    buckets = int(max(shuffle_width(docs.sparkSession), total // KEYS + 1))
    answers = sent(chunks, buckets).groupBy("bucket").applyInArrow(tallied, "bucket int, chunk bigint, told binary").withColumnRenamed("chunk", "owner")

    def put(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: rows.column(c)[0] for c in rows.column_names}
        place, per_doc, times, link, per_part, weights, keys = (unpack(row[c].as_py()) for c in ("parts", "per_doc", "times", "links", "per_part", "weights", "keys"))
        told = np.zeros(len(keys), np.int64)
        bucket = bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, data in zip(answers.column("bucket").to_pylist(), answers.column("told").to_pylist()):
            told[order[cuts[b] : cuts[b + 1]]] = unpack(data)
        of_part = np.concatenate([[0], np.cumsum(per_part)])
        best, total = (sums_by(v * weights, of_part) for v in ((told > 0)[link], np.abs(told)[link]))
        of_doc = np.concatenate([[0], np.cumsum(per_doc)])
        more = [sums_by(v[place] * times, of_doc) for v in (best, total)]
        out = [row[f"kept{i}"].values for i in range(len(keep))] + [row[c].values for c in COUNTS] + [pa.array(v) for v in more] + [row["groups"].values]
        return pa.Table.from_arrays(out, names=[*keep, *names])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{c}` bigint" for c in names[:-1]] + [f"`{names[-1]}` string"])
    return chunks.drop("docs", "n_keys").groupBy("chunk").cogroup(answers.groupBy("owner")).applyInArrow(put, schema)
