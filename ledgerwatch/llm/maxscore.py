"""Exact top-k search by inner product of integer vectors, with MaxScore over shards.

A vector's terms are its dimensions. Within a shard, a query with weight q at a dimension takes the dimension's postings
as gains over the worst value there (the smallest for positive q, the largest for negative q), so all gains
are non-negative and bounded by |q| times the dimension's spread. Terms go in order of their bounds. While the bounds of the
terms behind exceed the k-th best score so far, a term is essential: its postings are traversed for all rows. The
rest is non-essential: it is probed for rows that are still competitive only, and a row drops out as soon as its sum and
the bounds left fall below the k-th best score. A task takes some blocks of queries through several shards in
turn and keeps its k-th best scores; the k best of all tasks are merged per query.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part. A
shorter vector counts as 0 where it has no component. Of several rows with a query's id the least vector asks; rows with
the query's id are no candidates. Where a sum may be beyond 2^53 integers of any size are added; a score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import shuffle_width
from .vectors import finite, matrix

SHARD, BLOCK = 4096, 256  # rows of a shard, queries of a block
TURN, BATCH = 16, 16  # shards that a task takes in turn, blocks of queries that it takes through them
STEP = 8  # terms between two looks at the k-th best score
EXACT = 1 << 53  # sums below are exact in doubles
PACK = "number int, ids binary, cells binary"


def packed(rows: DataFrame, size: int, width: int, scale: float) -> tuple[DataFrame, int]:
    """Rows (id, vector) in blocks of about ``size``, by hash of id: one row of ids and floored cells per block; and their number."""
    n = max(1, -(-rows.count() // size))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        cells = np.floor(scale * matrix(table.column("vector"), width))
        if np.abs(cells).max(initial=0) < 1 << 31:
            cells = cells.astype(np.int32)
        order = np.argsort(ids, kind="stable")
        return pa.table({"number": pa.array([table.column("number")[0].as_py()], pa.int32()),
                         "ids": pa.array([ids[order].tobytes()], pa.binary()), "cells": pa.array([cells[order].tobytes()], pa.binary())})

    numbered = rows.withColumn("number", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return cut_lineage(numbered.groupBy("number").applyInArrow(pack, PACK)), n


def unpacked(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cells of a block, as doubles; larger ones than 32 bits were kept as such."""
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["cells"], np.int32 if len(row["cells"]) == 4 * len(ids) * width else np.float64).reshape(-1, width).astype(np.float64)


def whole_numbers(cells: np.ndarray) -> np.ndarray:
    """Cells as integers of any size."""
    return np.array([[int(v) for v in row] for row in cells.tolist()], object).reshape(cells.shape)


class Shard:
    """Rows of one shard in order of id, dimension by dimension."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(cells.T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def best(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores that may be among the k best; nothing at or above ``floor``, the k-th best so far, is left out."""
        worst = np.where(query > 0, self.low, self.high)
        bound = np.abs(query) * (self.high - self.low)
        order = np.argsort(-bound, kind="stable")
        order = order[query[order] != 0]
        left = np.append(np.cumsum(bound[order][::-1])[::-1], bound[:0].sum())  # bounds from each term on
        base = query @ worst
        rows = np.flatnonzero(self.ids != own)
        if not len(rows) or base + left[0] < floor:
            return self.ids[:0], self.columns[0, :0]
        total, at = np.full(len(self.ids), base, self.columns.dtype), 0
        while at < len(order) and base + left[at] >= floor:  # essential terms: all rows
            terms = order[at : at + STEP]
            total += query[terms] @ (self.columns[terms] - worst[terms, None])
            at += len(terms)
            sums = total[rows]
            if len(rows) > k:  # sums never fall, so k of them are a floor
                floor = max(floor, np.partition(sums, len(sums) - k)[len(sums) - k])
            alive = sums + left[at] >= floor
            if not alive.all():
                rows = rows[alive]
                if len(rows) < len(self.ids) // 4:
                    break
        total = total[rows]
        while at < len(order) and len(rows):  # the rest: competitive rows only
            terms = order[at : at + STEP]
            total = total + query[terms] @ (self.columns[np.ix_(terms, rows)] - worst[terms, None])
            at += len(terms)
            if len(total) > k:
                floor = max(floor, np.partition(total, len(total) - k)[len(total) - k])
            alive = total + left[at] >= floor
            rows, total = rows[alive], total[alive]
        some = np.lexsort((self.ids[rows], -total))[:k]
        return self.ids[rows[some]], total[some]


def search(rows: DataFrame, asks: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row of ``rows`` that fulfils ``asks``: the ``k`` other rows of highest inner product of
    floor(scale * component), ties to the smaller id: query_id, rank, vec_id, score."""
    usable, whole_id = rows.where(finite(F.col(vector)) & F.col(key).isNotNull()), F.col(key).cast("bigint").alias("id")
    queries = usable.where(asks).groupBy(whole_id).agg(F.min(vector).alias("vector"))
    usable = usable.select(whole_id, F.col(vector).alias("vector"))
    width = usable.agg(F.max(F.size("vector"))).first()[0] or 1
    (shards, n_shards), (blocks, n_blocks) = packed(usable, SHARD, width, scale), packed(queries, BLOCK, width, scale)
    # A batch of blocks meets every turn of shards once. Turns are short where shards are few, so that there are tasks enough.
    turn = min(TURN, max(1, n_shards // (2 * shuffle_width(rows.sparkSession))))
    # Both sides' keys are int: cogroup casts neither side, and an int and a bigint of one value hash to different tasks.
    place = lambda size: F.expr(f"number div {size}").cast("int")
    every = lambda n, size: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // size)).cast("array<int>"))
    met = shards.withColumn("turn", place(turn)).withColumn("batch", every(n_blocks, BATCH))
    asked = blocks.withColumn("batch", place(BATCH)).withColumn("turn", every(n_shards, turn))

    def answer(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        shards = [unpacked(row, width) for row in candidates.sort_by("number").to_pylist()]
        most = max((np.abs(cells).max(initial=0) for _, cells in shards), default=0)
        read: dict[bool, list[Shard]] = {}
        for row in questions.sort_by("number").to_pylist():
            ids, asking = unpacked(row, width)
            safe = 4.0 * width * most * np.abs(asking).max(initial=0) < EXACT
            if safe not in read:
                read[safe] = [Shard(own, cells if safe else whole_numbers(cells)) for own, cells in shards]
            asking = asking if safe else whole_numbers(asking)
            for i, own in enumerate(ids.tolist()):
                best_ids, best = np.zeros(0, np.int64), asking[0, :0]
                for shard in read[safe]:
                    got_ids, got = shard.best(asking[i], own, k, best[-1] if len(best) == k else -np.inf)
                    if len(got):
                        all_ids, scores = np.concatenate([best_ids, got_ids]), np.concatenate([best, got])
                        some = np.lexsort((all_ids, -scores))[:k]
                        best_ids, best = all_ids[some], scores[some]
                out.append((np.full(len(best), own), best_ids, best))
        columns = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3)]
        scores = pa.array([int(v) for v in columns[2]], pa.int64())  # an error where a score is beyond 64 bits
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": scores})

    found = met.select("batch", "turn", "number", "ids", "cells").groupBy("batch", "turn").cogroup(
        asked.select("batch", "turn", "number", "ids", "cells").groupBy("batch", "turn")).applyInArrow(
        answer, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
