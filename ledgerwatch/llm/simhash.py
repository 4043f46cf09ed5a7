"""Near duplicates by SimHash, found by multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. Of two fingerprints that differ in two bits at most, one segment
differs in one bit at most: each fingerprint therefore asks the table of a segment for every value in the ball of
radius one around its own, and the complete distance of what it gets is verified. Equal fingerprints are one
entry. A segment value with many fingerprints isn't fetched; the questions to it enumerate the ball of the
remaining distance in the other segment and look complete fingerprints up, so the work of a question is bounded.

Defined results: null and empty texts have fingerprint zero, which links like any other. A null id never becomes a
component's id unless no other is there. Rows with one id count as one document. Order and repetition of rows don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected
from .tables import column, free_name, side
from .text import slices, words_in

FETCHED = 64
SEGMENT = 32


def shingle_hashes(texts: pa.Array, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of all texts, repeats included; of the whole sequence where it is shorter. Text j has
    shingles[j] of them, from first[j]."""
    words = words_in(texts, lower=True)
    counts = np.diff(words.first)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(shingles)])
    text = np.repeat(np.arange(len(counts)), shingles)
    begin = words.first[text] + np.arange(first[-1]) - first[text]
    last = np.minimum(begin + size, words.first[text + 1]) - 1
    flat, digest = words.flat.tobytes(), xxhash.xxh64_intdigest
    spans = zip(words.start[begin].tolist(), words.end[last].tolist())
    hashes = np.fromiter((digest(flat[a:b], seed) for a, b in spans), np.uint64, first[-1])
    return hashes, shingles, first


def fingerprints(texts: pa.Array, size: int, seed: int = 42) -> np.ndarray:
    """SimHash of the ``size``-word shingles of every text."""
    hashes, shingles, first = shingle_hashes(texts, size, seed)
    out = np.zeros(len(shingles), np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(shingles)
    if len(some):
        # Sums of bytes would overflow, so bits are summed as counts per text.
        ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
        over = (2 * ones > shingles[some, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, size: int, key: str, name: str) -> DataFrame:
    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch({key: part.column(key), name: pa.array(fingerprints(part.column("text"), size), pa.int64())})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(computed, f"`{key}` {kind}, `{name}` bigint")


def segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1)) if k else fp.bitwiseAND(F.lit((1 << SEGMENT) - 1))


def balls(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with one to ``radius`` bits set; radius 2 at most."""
    one = [1 << i for i in range(bits)] if radius else []
    return one + ([a | b for i, a in enumerate(one) for b in one[:i]] if radius > 1 else [])


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of different values of ``prints`` (fp bigint, unique) that differ in ``distance`` bits at most (1 or 2)."""
    fp, rows = F.col("fp"), prints.count()
    value = lambda k: segment(fp, k)
    table = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), value(k).alias("value")) for k in (0, 1)])).alias("s")).select("fp", "s.*")
    # Stored, so that a join with it gets a shuffle of its own, whose large partitions adaptive execution can split.
    groups = cut_lineage(table.groupBy("k", "value").agg(F.count("*").alias("held")))
    # Each link is asked for by the end whose segment lacks the bit; from equal segments by both, kept once.
    flips = F.array(F.lit(0), *[F.lit(m).cast("bigint") for m in balls(SEGMENT, 1)])
    asked = table.withColumn("flip", F.explode(flips)).where(F.col("value").bitwiseAND(F.col("flip")) == 0)
    asked = asked.select(F.col("fp").alias("a"), "k", "flip", F.col("value").bitwiseOR(F.col("flip")).alias("value"))
    matched = cut_lineage(asked.join(side(groups, 2 * rows), ["k", "value"]).where("flip <> 0 or held > 1"))
    fetched = matched.where(F.col("held") <= FETCHED).join(side(table, 2 * rows), ["k", "value"]).select("a", F.col("fp").alias("b"))
    rest = lambda left: F.array(*[F.lit(m).cast("bigint") for m in [0] + balls(SEGMENT, left)])
    crowded = matched.where(F.col("held") > FETCHED).withColumn(
        "rest", F.explode(F.when(F.col("flip") == 0, rest(distance)).otherwise(rest(distance - 1))))
    place = lambda mask, k: F.shiftleft(mask, SEGMENT) if k else mask
    changed = F.when(F.col("k") == 0, F.col("flip").bitwiseOR(place(F.col("rest"), 1))).otherwise(place(F.col("flip"), 1).bitwiseOR(F.col("rest")))
    looked_up = crowded.select("a", F.col("a").bitwiseXOR(changed).alias("fp")).join(side(prints, rows), "fp").select("a", F.col("fp").alias("b"))
    pairs = fetched.unionByName(looked_up).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_groups(docs: DataFrame, size: int, distance: int = 2, key: str = "doc_id") -> DataFrame:
    """(key, fp, component) of every row; component is the smallest id in its group of near duplicates."""
    named = cut_lineage(with_fingerprints(docs, size, key, "fp").withColumnRenamed(key, "id"))
    prints = cut_lineage(named.groupBy("fp").agg(F.min("id").alias("low")))
    roots = cut_lineage(connected(links(prints.select("fp"), distance)))
    rows, nodes = prints.count(), roots.count()
    of_node = roots.join(side(prints.withColumnRenamed("fp", "node"), rows), "node")
    lows = cut_lineage(of_node.groupBy("component").agg(F.min("low").alias("least")))
    linked = roots.join(side(lows, nodes), "component").select(F.col("node").alias("fp"), F.col("least"))
    of_print = cut_lineage(prints.join(side(linked, nodes), "fp", "left").select("fp", F.coalesce("least", "low").alias("component")))
    # A fingerprint that very many rows share is a skewed key with one row on the other side: adaptive execution splits it.
    return named.join(side(of_print, rows), "fp").select(F.col("id").alias(key), "fp", "component")


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2, key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    found = fingerprint_groups(docs, size, distance, key)
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 3, distance: int = 2, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without those whose group of near duplicates has a document with a smaller id.

    Rows without id stay, as nothing names them; rows with one id stay or go together."""
    gone = free_name(docs, "gone")
    dropped = fingerprint_groups(docs, size, distance, key).where(f"`{key}` > component").select(column(key).alias(gone)).distinct()
    return docs.join(dropped, column(key) == F.col(gone), "left_anti")
