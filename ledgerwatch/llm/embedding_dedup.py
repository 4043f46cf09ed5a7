"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from the nearest vectors within blocks that agree in the signs of random projections. In every
round each vector brings its neighbours, and a bounded number of those that name it, together in a local join: whoever is nearer to one of them
than its last neighbour becomes a candidate. A list whose entries are all links is saturated: it is enlarged, and takes
links in hash order rather than the nearest, so that dense groups hang together instead of falling into cliques. The lists
bound the search only: every link that a block or a local join meets goes to a table of its own, whose components are the result. Then the recall
of links is audited: vectors that no audit has taken are compared with all rows, until enough of them have links. While too large
a share of a vector's links joins different components, in the mean over these vectors, further blocks and rounds follow; after
the last turn the audit goes on through the whole table instead, so no result is below the target. What an audit finds is kept.
Where links are rare, an audit ends after a bounded number of vectors. Links below the threshold are dropped.

Links of a vector lie within its component. Their number is counted there exactly, in tiles of the component's
vectors, without listing pairs; equal vectors are one entry with its number of copies throughout.

Defined results: vectors that are null, zero, or hold null or non-finite components have no links and are their own
component. Vectors of other lengths than most are compared as if they ended in zeros. Rows without id are left out
of the graph and their own component (null). Rows with one id and one vector count as copies of each other.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected
from .tables import shuffle_width
from .vectors import finite, matrix

LOG = logging.getLogger(__name__)
NEIGHBOURS = 10
LARGER = 30  # neighbours of saturated vectors
BLOCK = 512  # vectors of a starting block
TILE = 256
GROUP = 128  # vectors whose local joins one group holds
AUDITED = 256  # vectors of the first audit; each further one takes twice as many, up to MOST_AUDITED
MOST_AUDITED = 4096
LINKED = 256  # audited vectors with links that a recall is taken from
ENOUGH = 8192  # audited vectors after which it is taken from as many as there are
NEAR = 16  # tiles of a component that meet the others under one key
CELLS = 1 << 22  # similarities that a task holds at a time
PAIR = "a bigint, b bigint, sim double"


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pairs_table(a: list[np.ndarray], b: list[np.ndarray], sim: list[np.ndarray]) -> pa.Table:
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.table({"a": pa.array(join(a, np.int64)), "b": pa.array(join(b, np.int64)), "sim": pa.array(join(sim, np.float64))})


def tree(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a symmetric matrix of links that hold its components together: a spanning forest."""
    left, a, b = np.ones(len(hit), bool), [], []
    for root in range(len(hit)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(hit[i] & left)
            left[new] = False
            a.append(np.full(len(new), i))
            b.append(new)
            queue += new.tolist()
    return np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64)


def sign_bits(count: int) -> int:
    return max(1, math.ceil(math.log2(max(2, count / (BLOCK / 2)))))


def partitions(count: int, least: float, recall: float) -> int:
    """Random partitions after which two vectors of similarity ``least`` have agreed in all signs once, with chance ``recall``."""
    agree = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** sign_bits(count)
    return 1 if agree >= 1 else math.ceil(math.log(1 - min(recall, 0.999)) / math.log(1 - agree)) if agree > 0 else 1


def starting_pairs(nodes: DataFrame, width: int, count: int, trial: int, k: int, least: float) -> DataFrame:
    """The ``k`` nearest of each vector within its block of one random partition, and what else ties the block's links together."""
    bits = sign_bits(count)
    planes = np.random.default_rng(trial).normal(size=(width, bits))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = matrix(batch.column("vector"), width) @ planes > 0
            yield pa.record_batch({"node": batch.column("node"), "vector": batch.column("vector"),
                                   "code": pa.array(signs @ (1 << np.arange(bits)), pa.int64())})

    kind = nodes.schema["vector"].dataType.simpleString()
    codes = cut_lineage(nodes.select("node", "vector").mapInArrow(coded, f"node bigint, vector {kind}, code bigint"))
    parts = codes.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = codes.join(parts, "code").withColumn("part", F.pmod(F.xxhash64("node", F.lit(trial)), F.col("parts")))

    def nearest(table: pa.Table) -> pa.Table:
        ids, x = table.column("node").to_numpy(), units(matrix(table.column("vector"), width))
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        m = min(k, len(ids) - 1)
        if m < 1:
            return pairs_table([], [], [])
        top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        rows = np.repeat(np.arange(len(ids)), m)
        p, q = tree(sim >= least)
        return pairs_table([ids[rows], ids[p]], [ids[top.ravel()], ids[q]], [sim[rows, top.ravel()], sim[p, q]])

    return dealt.select("code", "part", "node", "vector").groupBy("code", "part").applyInArrow(nearest, PAIR)


def lists_of(pairs: DataFrame, sizes: DataFrame | None, least: float) -> DataFrame:
    """The best neighbours (a, b, sim) of each vector: links in hash order, then the nearest."""
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    link = F.col("sim") >= least
    order = Window.partitionBy("a").orderBy(
        link.desc(), F.when(link, F.xxhash64("a", "b")).otherwise(0), F.col("sim").desc(), F.col("b"))
    ranked = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= (NEIGHBOURS if sizes is None else LARGER))
    if sizes is not None:
        ranked = ranked.join(sizes, "a", "left").where((F.col("place") <= NEIGHBOURS) | F.col("large"))
    return cut_lineage(ranked.select("a", "b", "sim", "place"))


def tied(edges: DataFrame | None, pairs: DataFrame, least: float) -> DataFrame:
    """``edges`` (a, b) and all links of ``pairs``, each once."""
    more = pairs.where(F.col("sim") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return cut_lineage((more if edges is None else edges.unionByName(more)).distinct())


def refined(lists: DataFrame, nodes: DataFrame, width: int, count: int, least: float, trial: int) -> DataFrame:
    """One round of local joins: pairs of neighbours that are links or nearer than the last entry of either list."""
    back = lists.select(F.col("b").alias("u"), F.col("a").alias("v"))
    turn = Window.partitionBy("u").orderBy(F.xxhash64("u", "v", F.lit(trial)))
    back = back.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= NEIGHBOURS).select("u", "v")
    around = lists.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(back).distinct()
    last = lists.groupBy("a").agg(F.min("sim").alias("last"), F.count("*").alias("held"))
    state = nodes.select(F.col("node").alias("v"), "vector").join(last.withColumnRenamed("a", "v"), "v", "left").select(
        "v", "vector", F.when(F.col("held") >= NEIGHBOURS, F.least("last", F.lit(least))).otherwise(-2.0).alias("last"))
    groups = max(shuffle_width(nodes.sparkSession), count // GROUP + 1)
    rows = around.join(state, "v").withColumn("group", F.pmod(F.xxhash64("u"), F.lit(groups)).cast("int"))

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("u").combine_chunks()
        u, v, last = (table.column(c).to_numpy() for c in ("u", "v", "last"))
        x = units(matrix(table.column("vector"), width))
        cuts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1], [True]]))
        a, b, s = [], [], []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            sim = x[i:j] @ x[i:j].T
            np.fill_diagonal(sim, -3)
            better = (sim > last[i:j, None]) | (sim >= least)
            p, q = np.nonzero(better)
            a.append(v[i + p])
            b.append(v[i + q])
            s.append(sim[p, q])
        return pairs_table(a, b, s)

    return rows.select("group", "u", "v", "vector", "last").groupBy("group").applyInArrow(joined, PAIR)


def audited(nodes: DataFrame, width: int, least: float, after: tuple[int, int] | None, most: int) -> tuple[DataFrame, tuple[int, int] | None]:
    """All links (a, b, sim) of the ``most`` vectors that follow ``after`` in hash order, by comparison with every row, and where
    the next ones start: None if no vector is left."""
    h = F.xxhash64("node")
    left = nodes if after is None else nodes.where((h > after[0]) | ((h == after[0]) & (F.col("node") > after[1])))
    chosen = left.select("node", "vector", h.alias("h")).orderBy("h", "node").limit(most).toArrow()
    ids, x = chosen.column("node").to_numpy(), units(matrix(chosen.column("vector"), width))
    at = max(zip(chosen.column("h").to_pylist(), ids.tolist())) if len(ids) == most else None

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                other = part.column("node").to_numpy()
                sim = x @ units(matrix(part.column("vector"), width)).T
                p, q = np.nonzero((sim >= least) & (ids[:, None] != other[None, :]))
                yield from pairs_table([ids[p]], [other[q]], [sim[p, q]]).to_batches()

    return cut_lineage(nodes.select("node", "vector").mapInArrow(compared, PAIR)), at


def held_together(true: DataFrame, found: DataFrame) -> tuple[int, float]:
    """Audited vectors with links, and the sum of their shares of links within one component."""
    own = true.join(found.select(F.col("node").alias("a"), F.col("component").alias("of_a")), "a", "left").join(
        found.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b", "left")
    shares = own.groupBy("a").agg(F.avg(F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)).cast("int")).alias("share"))
    return shares.agg(F.count("*"), F.coalesce(F.sum("share"), F.lit(0.0))).first()


def link_counts(members: DataFrame, width: int, least: float) -> DataFrame:
    """(node, linked): vectors that each vector of a component (component, node, vector, copies) links with, itself left out."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    keys = F.ceil(F.col("tiles") / NEAR).cast("int")
    sizes = sizes.withColumn("keys", keys)
    dealt = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        x = units(matrix(table.column("vector"), width))
        return pa.table({"component": table.column("component")[:1], "tile": table.column("tile")[:1], "keys": table.column("keys")[:1],
                         "ids": pa.array([table.column("node").to_numpy().tobytes()], pa.binary()),
                         "copies": pa.array([table.column("copies").to_numpy().tobytes()], pa.binary()),
                         "cells": pa.array([x.tobytes()], pa.binary())})

    tiles = cut_lineage(dealt.select("component", "tile", "keys", "node", "vector", "copies").groupBy("component", "tile").applyInArrow(
        pack, "component bigint, tile int, keys int, ids binary, copies binary, cells binary"))
    # A large component has several keys: each tile is under one of them, and met there by all.
    other = tiles.select("component", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("key"), *[F.col(c).alias(f"other_{c}") for c in ("tile", "ids", "copies", "cells")])
    own = tiles.withColumn("key", F.pmod(F.col("tile"), F.col("keys"))).drop("keys")
    met = own.join(other, ["component", "key"]).where("tile <= other_tile")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, other = (np.frombuffer(row[c], np.int64) for c in ("ids", "other_ids"))
                n, m = (np.frombuffer(row[c], np.int64) for c in ("copies", "other_copies"))
                x, y = (np.frombuffer(row[c]).reshape(-1, width) for c in ("cells", "other_cells"))
                hit = x @ y.T >= least
                if row["tile"] == row["other_tile"]:
                    np.fill_diagonal(hit, False)
                    yield pa.record_batch({"node": pa.array(ids), "linked": pa.array(hit @ m)})
                else:
                    yield pa.record_batch({"node": pa.array(np.concatenate([ids, other])), "linked": pa.array(np.concatenate([hit @ m, hit.T @ n]))})

    return met.mapInArrow(counted, "node bigint, linked bigint").groupBy("node").agg(F.sum("linked").alias("linked"))


def near_vectors(rows: DataFrame, least: float = 0.9, recall: float = 0.98, key: str = "vec_id", vector: str = "embedding",
                 trials: int = 4, rounds: int = 2, most: int = 4, audits: int = ENOUGH, exact: bool = True) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``rows``.

    ``trials`` starting partitions, or as many more as the number of rows asks for, and ``rounds`` rounds; up to ``most`` times,
    while the audited recall of links is below ``recall``. If it still is, all vectors that no audit has compared are compared, unless
    ``exact`` is false. A recall is taken from 256 linked vectors, or from those among ``audits`` vectors: if none of so many
    is linked, less than 3 / audits of all vectors are, with a confidence of 95 %. Recalls go to the log."""
    named = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    usable = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull()
    vectors = cut_lineage(named.where(usable))
    nodes = cut_lineage(vectors.groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    count, width = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    trials = max(trials, partitions(count, least, recall))
    pairs, edges, found, after, size = None, None, None, None, AUDITED
    for turn in range(most if count else 0):
        for trial in range(trials):
            more = starting_pairs(nodes, width, count, turn * trials + trial, NEIGHBOURS, least)
            pairs = more if pairs is None else pairs.unionByName(more)
        pairs = cut_lineage(pairs)
        edges = tied(edges, pairs, least)
        lists = lists_of(pairs, None, least)
        for r in range(rounds):
            full = lists.where(F.col("sim") >= least).groupBy("a").agg((F.count("*") >= NEIGHBOURS).alias("large")).where("large")
            fresh = cut_lineage(refined(lists, nodes, width, count, least, turn * rounds + r))
            edges = tied(edges, fresh, least)
            lists = lists_of(lists.select("a", "b", "sim").unionByName(fresh), full, least)
        found = cut_lineage(connected(edges))
        edges = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        # Audits go on in hash order, so that none takes vectors whose links an earlier one has added.
        pairs, linked, share, looked = lists.select("a", "b", "sim"), 0, 0.0, 0
        while True:
            true, after = audited(nodes, width, least, after, size)
            looked += size
            size = min(2 * size, MOST_AUDITED)
            more, held = held_together(true, found)
            linked, share = linked + more, share + held
            edges, pairs = tied(edges, true, least), pairs.unionByName(true)
            told = linked >= LINKED or looked >= audits
            enough = told and share >= recall * linked
            if after is None or enough or (told and (turn + 1 < most or not exact)):
                break
        LOG.info("turn %d: %d vectors audited, %d of them linked, recall of their links %.4f", turn, looked, linked, share / linked if linked else 1.0)
        if after is None or enough:
            break
    if edges is not None:
        found = cut_lineage(connected(edges))
    if found is None:
        found = rows.sparkSession.createDataFrame([], "node bigint, component bigint")
    # Ids are taken from the smallest row of equal vectors, so the smallest node of a component is its smallest row.
    members = cut_lineage(nodes.join(found, "node").select("component", "node", "vector", "copies"))
    counts = link_counts(members, width, least)
    of_node = nodes.join(found, "node", "left").join(counts, "node", "left").select(
        "node", "vector", F.coalesce("component", "node").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    linked = vectors.join(of_node, "vector").select("id", "links", "component")
    alone = named.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
