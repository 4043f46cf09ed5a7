"""Collocations of two to five words by direct-address tiling.

Texts become chunks: sequences of word numbers with gaps where a piece ends, and each chunk's own dictionary. The words of enough
occurrences are ranked by frequency, and a chunk's numbers become ranks. Pairs of neighbouring ranks fall into square tiles: where
a tile of low ranks is crowded, its cells are counted by direct address (``bincount``); the other tiles are sparse and go through
sorted coordinates. Every chunk sends its distinct pairs, packed by strips of tiles, and the strips are summed the same
two ways. The frequent pairs are ranked again and take their first words' places, so that a phrase of k words is a pair of phrases of
k - 1 words, up to the longest length. A phrase is frequent only if both parts are, so nothing is missed.

A hot word or pair is one packed entry per chunk. The vocabulary is joined, not broadcast.

Defined results: null and empty texts have no words; a null language is ``und``. Order of rows doesn't matter; repeated rows count
as often as they are there. Languages are told apart by their whole names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .packed import joined, pack, ranked, unpack
from .tables import shuffle_width
from .text import LOWER, buffer_of, mixed, slices, strings, u64, whole

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09]] = True

SIDE = 8  # bits of a tile's side
CORNER = 8  # tiles, along each side, that may be counted by direct address
CROWDED = 16  # cells per occurrence, at most, of such a tile
CHUNK = 12 << 20  # bytes of text
PAIRS = 4 << 20  # pairs of words per bucket
MOST = (1 << 31) - 1  # ids


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of all words in order with -1 where a piece or text ends, the distinct words, and their counts."""
    flat, offsets = buffer_of(pc.binary_join_element_wise(whole(texts), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
    solid = ~(BREAK | GAP)[flat]
    outside = np.zeros(1, np.int8)
    edge = np.diff(np.concatenate([outside, solid.view(np.int8), outside]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64)
    found = strings(LOWER[flat[solid]], np.concatenate([[0], np.cumsum(end - start)])).dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.bincount(code, minlength=len(found.dictionary))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends = np.searchsorted(np.flatnonzero(BREAK[flat]), start)  # every text ends in a break
    new = np.flatnonzero(np.diff(ends)) + 1
    return np.insert(place[code], new, -1), found.dictionary.take(pa.array(order)), counts[order]


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, langs, words, counts, names, sizes, seq): sequences of word numbers, the words, and the words of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, held_bytes = TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal number, held, held_bytes
            table = pa.Table.from_batches(held).combine_chunks()
            lang = table.column("lang").combine_chunks().dictionary_encode()
            code = lang.indices.to_numpy(zero_copy_only=False)
            seq, words, counts, langs, names, sizes, at = [], [], [], [], [], [], 0
            for k, name in enumerate(lang.dictionary.to_pylist()):
                one, own, n = word_codes(table.column("text").filter(pa.array(code == k)))
                seq += [np.where(one < 0, -1, one + at), [-1]]
                words.append(own)
                counts.append(n)
                langs += [name] * len(own)
                names.append(name)
                sizes.append(int(n.sum()))
                at += len(own)
            listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            row = {"chunk": pa.array([number]), "langs": listed(pa.array(langs, pa.string())), "words": listed(pa.concat_arrays(words).cast(pa.string())),
                   "counts": listed(pa.array(np.concatenate(counts))), "names": listed(pa.array(names, pa.string())),
                   "sizes": listed(pa.array(sizes, pa.int64())), "seq": pa.array([pack(np.concatenate(seq))], pa.binary())}
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

    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return cut_lineage(rows.mapInArrow(
        run, "chunk bigint, langs array<string>, words array<string>, counts array<bigint>, names array<string>, sizes array<bigint>, seq binary"))


def pair_counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, as x << 32 | y in rising order, and their counts."""
    low = (x < CORNER << SIDE) & (y < CORNER << SIDE)
    tile = np.where(low, (x >> SIDE) * CORNER + (y >> SIDE), CORNER * CORNER)
    crowded = np.bincount(tile, minlength=CORNER * CORNER + 1) * CROWDED >= 1 << 2 * SIDE
    crowded[-1] = False
    dense = crowded[tile]
    place = np.cumsum(crowded) - 1
    mask = (1 << SIDE) - 1
    cells = place[tile[dense]] << 2 * SIDE | (x[dense] & mask) << SIDE | (y[dense] & mask)
    counts = np.bincount(cells, minlength=1)
    some = np.flatnonzero(counts)
    of = np.flatnonzero(crowded)[some >> 2 * SIDE] if len(cells) else some[:0]
    some = some[: len(of)]
    keys = ((of // CORNER) << SIDE | (some >> SIDE & mask)) << 32 | (of % CORNER) << SIDE | (some & mask)
    rest, n = np.unique(x[~dense] << 32 | y[~dense], return_counts=True)
    keys, counts = np.concatenate([keys, rest]), np.concatenate([counts[some], n])
    order = np.argsort(keys)
    return keys[order], counts[order]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and the sums of their counts: strips of tiles by direct address where they are crowded."""
    strips, strip = np.unique(keys >> SIDE, return_inverse=True)
    if len(strips) << SIDE <= CROWDED * len(keys) and counts.sum() < 1 << 53:
        total = np.bincount(strip << SIDE | (keys & ((1 << SIDE) - 1)), weights=counts, minlength=len(strips) << SIDE).astype(np.int64)
        some = np.flatnonzero(total)
        return strips[some >> SIDE] << SIDE | (some & ((1 << SIDE) - 1)), total[some]
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def sent(seqs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, keys, counts): distinct pairs of neighbours in every chunk, by strips of tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("seq")):
                seq = unpack(data.as_py())
                both = (seq[:-1] >= 0) & (seq[1:] >= 0)
                keys, counts = pair_counts(seq[:-1][both], seq[1:][both])
                bucket = (mixed((keys >> SIDE).astype(np.uint64)) % u64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(b, chunk, pack(keys[order[i:j]], True), pack(counts[order[i:j]])) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                     names=["bucket", "chunk", "keys", "counts"])

    return seqs.select("chunk", "seq").mapInArrow(run, "bucket int, chunk bigint, keys binary, counts binary")


def met(pairs: DataFrame, least: int) -> DataFrame:
    """Of every bucket, the pairs of ``least`` occurrences (chunk null, keys, sums), and for each chunk which of them it holds (keys,
    places among them)."""
    def run(table: pa.Table) -> pa.Table:
        keys, sizes = joined(table.column("keys").to_pylist())
        all_keys, total = summed(keys, joined(table.column("counts").to_pylist())[0])
        often = total >= least
        found = all_keys[often]
        rows = [(None, pack(found, True), pack(total[often]))] if len(found) else []
        place = np.searchsorted(found, keys)
        hit = place < len(found)
        hit[hit] = found[place[hit]] == keys[hit]
        ends = np.cumsum(sizes)
        for chunk, i, j in zip(table.column("chunk").to_pylist(), (ends - sizes).tolist(), ends.tolist()):
            own = np.flatnonzero(hit[i:j]) + i
            if len(own):
                rows.append((chunk, pack(keys[own], True), pack(place[own], True)))
        bucket = pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int32())
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table({"bucket": bucket, "chunk": pa.array(columns[0], pa.int64()), "keys": pa.array(columns[1], pa.binary()), "found": pa.array(columns[2], pa.binary())})

    return pairs.groupBy("bucket").applyInArrow(run, "bucket int, chunk bigint, keys binary, found binary")


def flat_pairs(answers: DataFrame) -> DataFrame:
    """(bucket, place, x, y, f): the frequent pairs, one a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, keys, total in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "found"))):
                keys, total = unpack(keys), unpack(total)
                yield pa.record_batch({"bucket": pa.array(np.full(len(keys), bucket), pa.int32()), "place": pa.array(np.arange(len(keys)), pa.int32()),
                                       "x": pa.array(keys >> 32), "y": pa.array(keys & 0xFFFFFFFF), "f": pa.array(total)})

    return answers.where("chunk IS NULL").select("bucket", "keys", "found").mapInArrow(run, "bucket int, place int, x bigint, y bigint, f bigint")


def replaced(seqs: DataFrame, answers: DataFrame, level: DataFrame) -> DataFrame:
    """Sequences (chunk, seq) in which every frequent pair's id stands at its first part's place."""
    told = with_ids(answers, level)

    def put(seq: pa.Table, told: pa.Table) -> pa.Table:
        out = [], []
        if told.num_rows:  # else nothing in the chunk is frequent
            keys, ids = joined(told.column("keys").to_pylist())[0], joined(told.column("ids").to_pylist())[0]
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            for chunk, data in zip(seq.column("chunk").to_pylist(), seq.column("seq").to_pylist()):
                old = unpack(data)
                pair = np.where((old[:-1] >= 0) & (old[1:] >= 0), old[:-1] << 32 | np.maximum(old[1:], 0), -1)
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                out[0].append(chunk)
                out[1].append(pack(short(np.where(keys[at] == pair, ids[at], -1))))
        return pa.table({"chunk": pa.array(out[0], pa.int64()), "seq": pa.array(out[1], pa.binary())})

    return cut_lineage(seqs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(put, "chunk bigint, seq binary"))


def short(seq: np.ndarray) -> np.ndarray:
    """Runs of -1 as one."""
    gap = seq < 0
    return seq[~(gap & np.append(False, gap[:-1]))] if len(seq) else seq


def sent_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, langs, words, places, counts): the distinct words of every chunk by hash, sorted and packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, langs, words, counts in zip(batch.column("chunk").to_pylist(), *(batch.column(c) for c in ("langs", "words", "counts"))):
                lang, words, counts = langs.values.dictionary_encode(), words.values.cast(pa.large_string()), counts.values.to_numpy()
                flat, offsets = buffer_of(words)
                code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.lexsort((pc.rank(words, "ascending", tiebreaker="dense").to_numpy(), code))
                bucket = (hashes(flat, offsets) % u64(buckets)).astype(np.int64)[order]
                at = order[np.argsort(bucket, kind="stable")]
                cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1)).tolist()
                names = lang.dictionary.to_pylist()
                rows = []
                for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if j > i:
                        some = at[i:j]
                        per = np.bincount(code[some], minlength=len(names))
                        text = "\n".join(words.take(pa.array(some)).to_pylist())
                        rows.append((b, chunk, [n for n, c in zip(names, per) if c], [int(c) for c in per if c], packed_text(text), pack(some), pack(counts[some])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), WORD_KINDS)], names=WORD_NAMES)

    return chunks.select("chunk", "langs", "words", "counts").mapInArrow(
        run, "bucket int, chunk bigint, langs array<string>, sizes array<bigint>, words binary, places binary, counts binary")


WORD_NAMES = ["bucket", "chunk", "langs", "sizes", "words", "places", "counts"]
WORD_KINDS = (pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())


def hashes(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of every word: sums of its bytes, each mixed with its place."""
    size = np.diff(offsets)
    place = np.arange(len(flat)) - np.repeat(offsets[:-1], size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(flat.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)), dtype=np.uint64)])
    return mixed(total[offsets[1:]] - total[offsets[:-1]])


def packed_text(text: str) -> bytes:
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked_text(data: bytes) -> str:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True).decode()


def met_words(words: DataFrame, least: int) -> DataFrame:
    """Of every bucket, the words of ``least`` occurrences (chunk null, langs, words, sums), and for each chunk which of them it holds (its own
    numbers, places among them)."""
    def run(table: pa.Table) -> pa.Table:
        langs, texts, numbers = [], [], []
        for names, sizes, text in zip(*(table.column(c).to_pylist() for c in ("langs", "sizes", "words"))):
            texts += text.split("\n") if (text := unpacked_text(text)) else []
            langs += [n for n, size in zip(names, sizes) for _ in range(size)]
        places, sizes = joined(table.column("places").to_pylist())
        counts = joined(table.column("counts").to_pylist())[0]
        lang, word = pa.array(langs, pa.string()).dictionary_encode(), pa.array(texts, pa.large_string()).dictionary_encode()
        key = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | word.indices.to_numpy(zero_copy_only=False)
        all_keys, place = np.unique(key, return_inverse=True)
        total = np.zeros(len(all_keys), np.int64)
        np.add.at(total, place, counts)
        often = total >= least
        number = np.cumsum(often) - 1
        bucket = table.column("bucket")[0].as_py()
        found = all_keys[often]
        rows = []
        if len(found):
            rows.append((None, lang.dictionary.take(pa.array(found >> 32)).to_pylist(), word.dictionary.take(pa.array(found & 0xFFFFFFFF)).to_pylist(), None, pack(total[often])))
        ends = np.cumsum(sizes)
        for chunk, i, j in zip(table.column("chunk").to_pylist(), (ends - sizes).tolist(), ends.tolist()):
            own = np.flatnonzero(often[place[i:j]]) + i
            if len(own):
                rows.append((chunk, None, None, pack(places[own]), pack(number[place[own]])))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.binary())
        return pa.table([pa.array([bucket] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                        names=["bucket", "chunk", "langs", "words", "keys", "found"])

    return words.groupBy("bucket").applyInArrow(run, "bucket int, chunk bigint, langs array<string>, words array<string>, keys binary, found binary")


def flat_words(answers: DataFrame) -> DataFrame:
    """(bucket, place, lang, phrase, f): the frequent words, one a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, langs, words, total in zip(batch.column("bucket").to_pylist(), batch.column("langs"), batch.column("words"), batch.column("found").to_pylist()):
                n = len(words.values)
                yield pa.record_batch({"bucket": pa.array(np.full(n, bucket), pa.int32()), "place": pa.array(np.arange(n), pa.int32()),
                                       "lang": langs.values, "phrase": words.values, "f": pa.array(unpack(total))})

    return answers.where("chunk IS NULL").select("bucket", "langs", "words", "found").mapInArrow(run, "bucket int, place int, lang string, phrase string, f bigint")


def with_ids(answers: DataFrame, level: DataFrame) -> DataFrame:
    """(chunk, keys, ids): what a chunk holds of the frequent words or pairs, by their ids."""
    ids = level.select("bucket", "place", "id").groupBy("bucket").applyInArrow(
        lambda table: pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()),
                                "ids": pa.array([pack(table.sort_by("place").column("id").to_numpy())], pa.binary())}), "bucket int, ids binary")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pack(unpack(i)[unpack(p)]) for i, p in zip(batch.column("ids").to_pylist(), batch.column("found").to_pylist())]
            yield pa.record_batch({"chunk": batch.column("chunk"), "keys": batch.column("keys"), "ids": pa.array(found, pa.binary())})

    return answers.where("chunk IS NOT NULL").join(ids, "bucket").select("chunk", "keys", "found", "ids").mapInArrow(named, "chunk bigint, keys binary, ids binary")


def with_word_ids(chunks: DataFrame, answers: DataFrame, words: DataFrame) -> DataFrame:
    """Sequences (chunk, seq) of the ids of frequent words."""
    def put(seq: pa.Table, told: pa.Table) -> pa.Table:
        place, ids = (joined(told.column(c).to_pylist())[0] for c in ("keys", "ids"))
        table = np.full(int(place.max(initial=-1)) + 2, -1, np.int64)
        table[place] = ids
        data = []
        for blob in seq.column("seq").to_pylist():
            old = unpack(blob)
            data.append(pack(short(table[np.minimum(old, len(table) - 1)])))  # gaps and words without id: the last entry
        return pa.table({"chunk": seq.column("chunk").cast(pa.int64()), "seq": pa.array(data, pa.binary())})

    seqs = chunks.select("chunk", "seq").groupBy("chunk").cogroup(with_ids(answers, words).groupBy("chunk"))
    return cut_lineage(seqs.applyInArrow(put, "chunk bigint, seq binary"))


def enriched(level: DataFrame, parts: DataFrame) -> DataFrame:
    """Phrases with their words, and the frequencies of all they begin and end with, shortest first."""
    left = parts.select(F.col("id").alias("x"), "lang", F.col("phrase").alias("head"), "begins")
    right = parts.select(F.col("id").alias("y"), "last", "ends")
    both = level.join(left, "x").join(right, "y")
    return cut_lineage(both.select(
        "id", "x", "y", "f", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last",
        F.concat("begins", F.array("f")).alias("begins"), F.concat("ends", F.array("f")).alias("ends")))


def scored(phrases: DataFrame, length: int, scale: int) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut, ties to the shortest first part."""
    wide = lambda c: c.cast("decimal(38,0)")
    cuts = []
    for k in range(1, length):
        l, r = F.col("begins")[k - 1], F.col("ends")[length - k - 1]
        # floor(scale * f * n / (l * r)), as f / l <= 1 and n / r fit: quotients of whole decimals are exact.
        score = F.call_function("div", wide(F.lit(scale)) * wide(F.col("f")) * wide(F.col("n")), wide(l) * wide(r))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return phrases.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0]).select("*", "cut.score", "cut.l", "cut.r").drop("cut")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, scale: int = 1000, most: int = 2000, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``most`` phrases of 2 to ``longest`` words and ``least`` occurrences.

    A phrase inside a longer one of at least ``share`` percent of its occurrences is left out; as phrases get no more frequent by a further
    word, it is enough to look at those of one word more."""
    spark = docs.sparkSession
    chunks = chunked(docs, chunk)
    sizes = chunks.select(F.explode(F.arrays_zip("names", "sizes")).alias("s")).groupBy(F.col("s.names").alias("lang")).agg(F.sum("s.sizes").alias("n"))
    sizes = cut_lineage(sizes)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = int(max(shuffle_width(spark), total // PAIRS + 1))
    rank = lambda rows, *ties: cut_lineage(ranked(rows, [F.desc("f"), *ties]))
    answers = cut_lineage(met_words(sent_words(chunks, buckets), least))
    words = rank(flat_words(answers), F.asc("lang"), F.asc("phrase"))
    phrases = words.select("*", F.col("phrase").alias("last"), F.array("f").alias("begins"), F.array("f").alias("ends"))
    seqs = with_word_ids(chunks, answers, words)
    levels = []
    for length in range(2, longest + 1):
        answers = cut_lineage(met(sent(seqs, buckets), least))
        level = rank(flat_pairs(answers), F.asc("x"), F.asc("y"))
        count = level.count()
        if count > MOST:
            raise ValueError("more frequent phrases than ids")
        phrases = enriched(level, phrases)
        levels.append(phrases)
        if not count:
            break
        if length < longest:
            seqs = replaced(seqs, answers, level)
    kept = []
    for k, level in enumerate(levels):
        rows = scored(level.join(sizes, "lang"), k + 2, scale)
        if k + 1 < len(levels):
            longer = levels[k + 1]
            around = longer.select(F.explode(F.array("x", "y")).alias("id"), F.col("f").alias("more")).groupBy("id").agg(F.max("more").alias("more"))
            rows = rows.join(around, "id", "left").where(F.col("more").isNull() | (100 * F.col("more") < share * F.col("f"))).drop("more")
        kept.append(rows.select("lang", "phrase", F.col("f").alias("a"), "l", "r", "n", "score"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
