"""Exact removal of word sequences that an earlier document holds too, by super-k-mers.

Consecutive windows of a document share the smallest hash among their word pairs, their minimiser. Such a run
of windows travels as one packed string to the bucket of its minimiser; equal windows always meet there,
whatever surrounds them. Within a bucket, windows are sorted by hash and equal neighbours compared byte by byte.

Skew. Documents are dealt into blocks by hash of id and text. Within a block a run that occurs many times is sent
once, with the smallest and largest document that holds it, and the bucket answers blocks, not documents. A pair
of words that is frequent in the whole table yields its place as minimiser to rarer ones; windows made of frequent pairs
alone go to the bucket of their own hash.

Defined results: null and empty texts have no words. A null id counts as larger than any number, so its windows
never take precedence; rows with equal ids do not remove each other's words. Order and repetition of rows don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import column, free_name, shuffle_width
from .text import Words, mixed, paired, ragged, slices, strings, u64, whole, words_in, words_of

SLOT_BITS = 16
LAST = np.iinfo(np.int64).max
PACKED = "block int, bucket int, meta binary, text binary"
ANSWER = "block int, meta binary"


def pair_keys(words: Words, sums: np.ndarray, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and the order of word pairs: frequent pairs last."""
    h = words.span_hashes(sums, words.start, words.end)
    keys = paired(h[:-1], h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    if frequent is not None:
        keys = (keys >> np.uint64(1)) | (frequent[keys >> np.uint64(64 - SLOT_BITS)].astype(np.uint64) << np.uint64(63))
    return h, keys


def window_hashes(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    value = h[at]
    for i in range(1, length):
        value = paired(value, h[at + i])
    return value


def runs(words: Words, length: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: first word, last word, route, and text of each run of windows that share a minimiser."""
    none = np.zeros(0, np.int64)
    n = words.n - length + 1
    if n <= 0:
        return none, none, none.astype(np.uint64), none
    sums = words.byte_sums()
    h, low = pair_keys(words, sums, frequent)
    span, width = 1, length - 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n], low[width - span : width - span + n])
    text = words.text_of()
    valid = text[:n] == text[length - 1 :]
    route = low[:n].copy()
    crowded = np.flatnonzero(valid & (route >> np.uint64(63) == 1))
    if len(crowded):
        route[crowded] = window_hashes(h, crowded, length)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (route[1:] != route[:-1]) | (text[1:n] != text[: n - 1])
    begin = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(stop) + length - 1
    return begin, last, mixed(route[begin]), text[begin]


def sorted_block(table: pa.Table, key: str) -> pa.Table:
    """The block's rows in an order that depends on their content alone."""
    return table.sort_by([(key, "ascending"), ("text", "ascending")])


def ids_of(table: pa.Table, key: str) -> np.ndarray:
    return table.column(key).cast(pa.int64()).fill_null(LAST).to_numpy()


class Block:
    """A block's words, its super-k-mers, and for each of them the first equal one."""

    def __init__(self, table: pa.Table, key: str, length: int, frequent: np.ndarray):
        self.words = words_in(table.column("text"))
        self.ids = ids_of(table, key)
        self.begin, self.last, self.route, self.text = runs(self.words, length, frequent)
        self.windows = self.last - self.begin - length + 2
        self.doc = self.ids[self.text] if len(self.text) else self.text
        self.start, self.end = self.words.start[self.begin], self.words.end[self.last]
        n = len(self.begin)
        self.same = np.arange(n)
        if n:
            hashes = self.words.span_hashes(self.words.byte_sums(), self.start, self.end)
            order = np.argsort(hashes, kind="stable")
            flat = self.words.flat.tobytes()
            again = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
            for k in again:  # rows that repeat, compared byte by byte
                one, other = self.same[order[k]], order[k + 1]
                if flat[self.start[one] : self.end[one]] == flat[self.start[other] : self.end[other]]:
                    self.same[other] = one
            self.flat = flat

    def packed(self, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        """For every bucket: numbers, smallest and largest ids, and texts of the distinct super-k-mers."""
        n = len(self.begin)
        if not n:
            return
        low, high = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, self.same, self.doc)
        np.maximum.at(high, self.same, self.doc)
        kept = np.flatnonzero(self.same == np.arange(n))
        bucket = (self.route[kept] % u64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        kept, bucket = kept[order], bucket[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(kept)]])
        start, end, flat, codec = self.start.tolist(), self.end.tolist(), self.flat, pa.Codec("zstd")
        for a, b in zip(cuts[:-1], cuts[1:]):
            some = kept[a:b]
            text = b"\n".join([flat[start[i] : end[i]] for i in some.tolist()]) + b"\n"
            meta = np.concatenate([[len(text)], some, low[some], high[some]]).astype(np.int64)
            yield int(bucket[a]), shrunk(meta), codec.compress(text, asbytes=True)


def shrunk(values: np.ndarray) -> bytes:
    return len(values).to_bytes(4, "little") + pa.Codec("zstd").compress(values.tobytes(), asbytes=True)


def grown(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[4:], n * 8, asbytes=True), np.int64)


def frequent_pairs(docs: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """Slots of word pairs that hold eight times their share, at most an eighth of all; and the bytes of all words.

    Steers the routing only; results do not depend on it."""
    slots = 1 << SLOT_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = np.zeros(slots, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_in(part.column("text"))
                size += len(words.flat)
                keys = pair_keys(words, words.byte_sums(), None)[1]
                counts += np.bincount((keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=slots)
        some = np.flatnonzero(counts > max(1, 4 * counts.sum() / slots))
        yield pa.record_batch({
            "slot": pa.array(np.concatenate([[-1, -2], some]), pa.int32()),
            "n": pa.array(np.concatenate([[counts.sum(), size], counts[some]]), pa.int64()),
        })

    totals = docs.select("text").mapInArrow(counted, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    whole_size = {r.slot: r.n for r in totals.where("slot < 0").collect()}  # two rows
    least = 8 * (whole_size.get(-1) or 0) / slots
    frequent = np.zeros(slots, bool)
    rows = totals.where((F.col("slot") >= 0) & (F.col("n") > least)).select("slot").collect()  # slots / 8 at most
    frequent[[r.slot for r in rows]] = True
    return frequent, whole_size.get(-2) or 0


def answers(table: pa.Table, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """One bucket: for each block, [number, windows, smallest id of each window] of every super-k-mer in which a
    window also occurs in a smaller document than the block knows of."""
    rows = table.num_rows
    metas = [grown(m) for m in table.column("meta").to_pylist()]
    sizes = [(len(m) - 1) // 3 for m in metas]
    codec = pa.Codec("zstd")
    text = b"".join(codec.decompress(t, int(m[0]), asbytes=True) for t, m in zip(table.column("text").to_pylist(), metas))
    number, low, high = (np.concatenate([m[1 + k * s : 1 + (k + 1) * s] for m, s in zip(metas, sizes)]) for k in range(3))
    block = np.repeat(table.column("block").to_numpy(), sizes)
    flat = np.frombuffer(text, np.uint8)
    offsets = np.concatenate([[0], np.flatnonzero(flat == 10) + 1])
    words = words_of(flat.copy(), offsets)
    text_of = words.text_of()
    n = words.n - length + 1
    at = np.flatnonzero(text_of[:n] == text_of[length - 1 :])
    h = words.span_hashes(words.byte_sums(), words.start, words.end)
    value = window_hashes(h, at, length)
    order = np.argsort(value, kind="stable")
    at, value = at[order], value[order]
    equal = np.concatenate([[False], value[1:] == value[:-1]])
    data = words.flat.tobytes()
    start, end = words.start[at], words.end[at + length - 1]
    odd = [k for k in np.flatnonzero(equal).tolist() if data[start[k] : end[k]] != data[start[k - 1] : end[k - 1]]]
    if odd:  # two sequences with one hash: order such runs by their words
        for k in odd:
            a = k - 1
            while a and equal[a]:
                a -= 1
            b = k
            while b < len(at) and equal[b]:
                b += 1
            spans = sorted((data[words.start[i] : words.end[i + length - 1]], i) for i in at[a:b].tolist())
            at[a:b] = [i for _, i in spans]
            equal[a + 1 : b] = [x[0] == y[0] for x, y in zip(spans, spans[1:])]
    group = np.cumsum(~equal) - 1
    mine = low[text_of[at]]
    first = np.flatnonzero(~equal)
    smallest = np.minimum.reduceat(mine, first)[group] if len(at) else mine
    back = np.argsort(at, kind="stable")
    at, smallest, mine = at[back], smallest[back], mine[back]
    owner = text_of[at]
    told = np.zeros(len(number), bool)
    told[owner[(smallest < mine) & (smallest < high[owner])]] = True
    per = np.diff(np.searchsorted(owner, np.arange(len(number) + 1)))
    begin = np.cumsum(per) - per
    some = np.flatnonzero(told)
    some = some[np.argsort(block[some], kind="stable")]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block[some])) + 1, [len(some)]]) if len(some) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        s = some[a:b]
        yield int(block[s[0]]), np.concatenate([[len(s)], number[s], per[s], smallest[ragged(begin[s], per[s])]])


def covered(block: Block, told: list[np.ndarray], length: int) -> np.ndarray:
    """Which words a window covers that starts in a smaller document too."""
    n = len(block.begin)
    mark = np.zeros(block.words.n + 1, np.int64)
    if n:
        low = np.full(n, LAST)
        np.minimum.at(low, block.same, block.doc)
        first = np.cumsum(block.windows) - block.windows
        smallest = np.repeat(low[block.same], block.windows)
        own = np.zeros(n, bool)
        for values in told:
            k = int(values[0])
            number, per = values[1 : 1 + k], values[1 + k : 1 + 2 * k]
            smallest[ragged(first[number], per)] = values[1 + 2 * k :]
            own[number] = True
        other = np.flatnonzero(own[block.same] & (block.same != np.arange(n)))
        smallest[ragged(first[other], block.windows[other])] = smallest[ragged(first[block.same[other]], block.windows[other])]
        again = np.flatnonzero(smallest < np.repeat(block.doc, block.windows))
        at = ragged(block.begin, block.windows)[again]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + length, -1)
    return np.cumsum(mark)[:-1] > 0


def kept_texts(words: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of every text, joined by one space: bytes and offsets, the last space of a text still on."""
    size = words.end - words.start + 1
    flat = words.flat if not gone.any() else words.flat[np.repeat(~gone, size)]
    total = np.concatenate([[0], np.cumsum(np.where(gone, 0, size))])
    return flat, total[words.first]


def remove_repeats(docs: DataFrame, length: int = 13, key: str = "doc_id", keep: str = "text",
                   block_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """Removes the words that a window of ``length`` words covers which also starts in a document with a smaller id.

    ``keep``: "text" returns the columns of ``docs`` with the kept words, joined by one space, as text (texts that
    lose nothing stay as they are); "digest" returns the id and kept_sha256 instead. Both add n_words and n_removed.
    """
    spark = docs.sparkSession
    block, n_words, n_removed = (free_name(docs, c) for c in ("block", "n_words", "n_removed"))
    if keep == "digest":
        docs = docs.select(key, "text")
    frequent, size = frequent_pairs(docs, length)
    # Every block sends one packed row to each bucket, so both counts follow the size, or the tasks where it is small.
    blocks = max(shuffle_width(spark), size // block_bytes + 1)
    buckets = max(4 * shuffle_width(spark), 3 * size // bucket_bytes)
    fields = docs.columns
    # The text takes part, so that rows without id spread as well.
    dealt = docs.withColumn(block, F.pmod(F.xxhash64(column(key), F.col("text")), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(shuffle_width(spark), F.col(block))

    def pack(data: pa.Table) -> pa.Table:
        number = data.column(block)[0].as_py()
        found = [(number, *row) for row in Block(sorted_block(data, key), key, length, frequent).packed(buckets)]
        names, kinds = ("block", "bucket", "meta", "text"), (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([r[i] for r in found], kinds[i]) for i, c in enumerate(names)})

    def answer(data: pa.Table) -> pa.Table:
        found = [(number, shrunk(values)) for number, values in answers(data, length)]
        return pa.table({"block": pa.array([r[0] for r in found], pa.int32()), "meta": pa.array([r[1] for r in found], pa.binary())})

    def clean(data: pa.Table, told: pa.Table) -> pa.Table:
        data = sorted_block(data, key).combine_chunks()
        mine = Block(data, key, length, frequent)
        gone = covered(mine, [grown(m) for m in told.column("meta").to_pylist()], length)
        words = mine.words
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        flat, offsets = kept_texts(words, gone)
        out = {c: data.column(c) for c in fields if c != "text"}
        ends = np.maximum(offsets[:-1], offsets[1:] - 1)
        if keep == "digest":
            view, digest = memoryview(np.ascontiguousarray(flat)), hashlib.sha256
            out["kept_sha256"] = pa.array([digest(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), ends.tolist())], pa.string())
        else:
            old = whole(data.column("text"))
            new = old.to_pylist() if removed.any() else None
            raw = flat.tobytes() if new else b""
            for i in np.flatnonzero(removed).tolist():
                new[i] = raw[offsets[i] : ends[i]].decode()
            text = data.column("text") if new is None else pa.array([
                None if was is None else now for was, now in zip(data.column("text").to_pylist(), new)], pa.string())
            out["text"] = text.cast(pa.string())
        out[n_words] = pa.array(np.diff(words.first), pa.int64())
        out[n_removed] = pa.array(removed, pa.int64())
        return pa.table({c: out[c] for c in names})

    names = [c for c in fields if keep != "digest" or c != "text"]
    names += (["kept_sha256"] if keep == "digest" else []) + [n_words, n_removed]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema} | {n_words: "bigint", n_removed: "bigint", "kept_sha256": "string"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    told = (
        dealt.groupBy(block).applyInArrow(pack, PACKED)
        .groupBy("bucket").applyInArrow(answer, ANSWER)
    )
    return dealt.groupBy(block).cogroup(told.groupBy("block")).applyInArrow(clean, schema)
