"""Training of the two-layer neighbour-averaging network with gradients that Spark sums over the graph's parts.

Accounts of one customer lie in one part, so a customer's sums are made there. Groups that cross parts - the few tiers, and customers
with very many accounts - are summed over all parts: their sums in the forward pass, their gradients in the backward pass. An epoch is
three passes over the parts; a pass returns sums of fixed size, and the driver keeps the weights (Adam, Kingma and Ba 2015).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import group_totals, united

# Training parameters.
RATE, DECAY, CLIP = 0.005, 1e-4, 1.0
HALVED_EVERY, CHECKED_EVERY, PATIENCE = 30, 10, 4
PART = 20_000  # accounts of a part, about
WIDE = 10_000  # accounts from which a customer is summed over all parts
SLOTS = 16  # results of more parts than this are summed in tasks first

Weights = list[tuple[np.ndarray, ...]]


@dataclass
class Part:
    """Accounts with features and their neighbour means, and up to three groups each: customer, tier, and what both share. Groups count
    from 0 in the part; those of all parts follow behind ``local``; -1 is none."""

    x: np.ndarray
    near: np.ndarray
    count: np.ndarray
    groups: np.ndarray
    local: int
    label: np.ndarray
    weight: np.ndarray  # 0 for accounts that are not trained on

    @staticmethod
    def of(table: pa.Table, wide: dict[str, int]) -> Part:
        n = table.num_rows
        rows = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        customer, tier = table.column("customer_group").to_pylist(), table.column("tier_group").to_pylist()
        names, groups = {}, np.full((n, 3), -1)
        for i, (c, t) in enumerate(zip(customer, tier)):
            for j, name in enumerate((c, None if t is None else f"tier/{t}", None if t is None else f"{c}|tier/{t}")):
                if name is not None:
                    groups[i, j] = -2 - wide[name] if name in wide else names.setdefault(name, len(names))
        groups = np.where(groups <= -2, len(names) - 2 - groups, groups)
        column = lambda c: table.column(c).to_numpy().astype(np.float64)
        return Part(rows("x"), rows("near"), column("n"), groups, len(names), column("label"), column("weight"))

    def sums(self, h: np.ndarray, across: np.ndarray) -> np.ndarray:
        """Sums of ``h`` by group, those of all parts from ``across``; the last row, of no group, is 0."""
        out = np.zeros((self.local + len(across) + 1, h.shape[1]))
        for j in range(3):
            some = self.groups[:, j] >= 0
            np.add.at(out, self.groups[some, j], h[some])
        out[self.local : -1] = across
        return out

    def across(self, h: np.ndarray, wide: int) -> np.ndarray:
        """What the part adds to the sums of the groups of all parts."""
        out = np.zeros((wide, h.shape[1]))
        for j in range(3):
            some = self.groups[:, j] >= self.local
            np.add.at(out, self.groups[some, j] - self.local, h[some])
        return out

    def first(self, weights: Weights) -> np.ndarray:
        a, b, c = weights[0]
        return np.maximum(self.near @ a + self.x @ b + c, 0.0)

    def second(self, weights: Weights, h1: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbour means of the first layer, the second layer, and the probability of class 1."""
        a, b, c = weights[1]
        w, v = weights[2]
        sums = self.sums(h1, across)
        mean = (sums[self.groups[:, 0]] + sums[self.groups[:, 1]] - sums[self.groups[:, 2]]) / self.count[:, None]
        h2 = np.maximum(mean @ a + h1 @ b + c, 0.0)
        out = h2 @ w + v
        return mean, h2, 1 / (1 + np.exp(np.clip(out[:, 0] - out[:, 1], -500, 500)))

    def backward(self, weights: Weights, across: np.ndarray) -> tuple[np.ndarray, ...]:
        """First layer, means, second layer, probability, and the gradients of the output, the second layer, and the means by node."""
        h1 = self.first(weights)
        mean, h2, p = self.second(weights, h1, across)
        slope = (p - self.label) * self.weight
        out = np.stack([-slope, slope], 1)
        d2 = (out @ weights[2][0].T) * (h2 > 0)
        return h1, mean, h2, p, out, d2, (d2 @ weights[1][0].T) / self.count[:, None]

    def signed(self, d: np.ndarray, wide: int) -> np.ndarray:
        """Gradients of all group sums: those of what both groups share count against."""
        out = np.zeros((self.local + wide + 1, d.shape[1]))
        for j, sign in enumerate((1.0, 1.0, -1.0)):
            some = self.groups[:, j] >= 0
            np.add.at(out, self.groups[some, j], sign * d[some])
        return out

    def gradients(self, weights: Weights, across: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        """Gradients of all weights, then loss, hits, false alarms and misses, as one vector."""
        h1, mean, h2, p, out, d2, means = self.backward(weights, across)
        by_group = self.signed(means, len(across))
        by_group[self.local : -1] = slopes
        by_group[-1] = 0
        d1 = d2 @ weights[1][1].T + sum(by_group[self.groups[:, j]] for j in range(3))
        d1 = d1 * (h1 > 0)
        trained, said = self.weight > 0, p >= 0.3
        loss = -(self.weight * np.where(self.label == 1, np.log(np.maximum(p, 1e-300)), np.log(np.maximum(1 - p, 1e-300)))).sum()
        counts = [(trained & said & (self.label == 1)).sum(), (trained & said & (self.label == 0)).sum(), (trained & ~said & (self.label == 1)).sum()]
        parts = [self.near.T @ d1, self.x.T @ d1, d1.sum(0), mean.T @ d2, h1.T @ d2, d2.sum(0), h2.T @ out, out.sum(0), [loss, *counts]]
        return np.concatenate([np.ravel(g) for g in parts])


Run = Callable[[Callable[[Part], np.ndarray]], np.ndarray]


def epoch(run: Run, weights: Weights, wide: int) -> np.ndarray:
    """The gradient vector of all parts. ``run`` sums a function over the parts."""
    width = len(weights[0][2])
    across = slopes = np.zeros((wide, width))
    if wide:
        across = run(lambda part: part.across(part.first(weights), wide)).reshape(wide, width)
        slopes = run(lambda part: part.signed(part.backward(weights, across)[-1], wide)[part.local : -1]).reshape(wide, width)
    return run(lambda part: part.gradients(weights, across, slopes))


@dataclass
class Adam:
    """Adam with decay and clipping; the rate halves as it goes."""

    rate: float = RATE
    step: int = 0
    moments: list[np.ndarray] = field(default_factory=list)

    def moved(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        gradient = gradient * min(1.0, CLIP / max(float(np.linalg.norm(gradient)), 1e-12)) + DECAY * flat
        self.moments = self.moments or [np.zeros_like(flat), np.zeros_like(flat)]
        first, second = self.moments
        first *= 0.9
        first += 0.1 * gradient
        second *= 0.999
        second += 0.001 * gradient**2
        rate = self.rate * 0.5 ** (self.step // HALVED_EVERY)
        self.step += 1
        return flat - rate * (first / (1 - 0.9**self.step)) / (np.sqrt(second / (1 - 0.999**self.step)) + 1e-8)


def flattened(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for layer in weights for w in layer])


def shaped(flat: np.ndarray, like: Weights) -> Weights:
    out, at = [], 0
    for layer in like:
        own = []
        for w in layer:
            own.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        out.append(tuple(own))
    return out


def to_json(weights: Weights) -> str:
    return json.dumps([[w.tolist() for w in layer] for layer in weights])


def from_json(text: str) -> Weights:
    return [tuple(np.array(w) for w in layer) for layer in json.loads(text)]


def trained(run: Run, weights: Weights, wide: int, epochs: int, rate: float = RATE) -> Weights:
    """Weights after at most ``epochs``; those of the best F1 on the training accounts, which is looked at from time to time, stay."""
    flat, adam = flattened(weights), Adam(rate)
    best, kept, waited = -1.0, flat, 0
    for turn in range(epochs + 1):
        found = epoch(run, shaped(flat, weights), wide)
        if turn % CHECKED_EVERY == 0 or turn == epochs:
            hits, false, missed = found[-3:]
            f1 = 2 * hits / max(2 * hits + false + missed, 1)
            best, kept, waited = (f1, flat, 0) if f1 > best else (best, kept, waited + 1)
            if waited >= PATIENCE:
                break
        if turn < epochs:
            flat = adam.moved(flat, found[: len(flat)])
    return shaped(kept, weights)


def parts_of(nodes: DataFrame, columns: list[str], class_weight: float) -> tuple[DataFrame, dict[str, int]]:
    """Accounts by part, stored, and the groups of all parts. ``nodes``: account_id, both groups, label, split and the scaled columns."""
    count = F.count("*")
    many = nodes.groupBy("customer_group").agg(count.alias("n")).where(F.col("n") > WIDE).select("customer_group")
    tiers = [r[0] for r in nodes.where("tier_group IS NOT NULL").select("tier_group").distinct().orderBy("tier_group").collect()]  # four codes
    customers = [r[0] for r in many.orderBy("customer_group").collect()]  # one in WIDE accounts at most
    names = [f"tier/{t}" for t in tiers] + customers + [f"{c}|tier/{t}" for c in customers for t in tiers]
    totals = group_totals(nodes, {f"_{c}": F.col(c) for c in columns})
    n = united("_n")
    weight = F.when(F.col("split") != "train", 0.0).when(F.col("label") == 1, class_weight).otherwise(1.0)
    rows = totals.select(
        "account_id", "customer_group", "tier_group", F.col("label").cast("double").alias("label"), weight.alias("weight"), n.cast("double").alias("n"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.array(*[(united(f"_{c}") / n).cast("double") for c in columns]).alias("near"))
    rows = cut_lineage(rows)
    size, total = rows.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    spread = F.when(F.col("customer_group").isin(customers), F.xxhash64("account_id")).otherwise(F.xxhash64("customer_group")) if customers else F.xxhash64("customer_group")
    bucket = F.pmod(spread, F.lit(max(1, size // PART + 1))).cast("int")
    rows = rows.withColumn("weight", F.col("weight") / F.lit(total or 1.0)).withColumn("bucket", bucket)

    def pack(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.sort_by("account_id"))
        return pa.table({"part": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return cut_lineage(rows.groupBy("bucket").applyInArrow(pack, "part binary")), {name: i for i, name in enumerate(names)}


def summed(parts: DataFrame, wide: dict[str, int]) -> Run:
    """Sums of a function over the stored parts."""
    crowded = parts.rdd.getNumPartitions() > SLOTS

    def run(function: Callable[[Part], np.ndarray]) -> np.ndarray:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for data in batch.column("part").to_pylist():
                    value = np.asarray(function(Part.of(pa.ipc.open_stream(data).read_all(), wide)), np.float64).ravel()
                    total = value if total is None else total + value
            if total is not None:
                yield pa.record_batch({"sums": pa.array([total.tobytes()], pa.binary())})

        def together(table: pa.Table) -> pa.Table:
            return pa.table({"sums": pa.array([sum(np.frombuffer(v) for v in table.column("sums").to_pylist()).tobytes()], pa.binary())})

        found = parts.mapInArrow(each, "sums binary")
        if crowded:
            found = found.groupBy(F.pmod(F.spark_partition_id(), F.lit(SLOTS)).alias("slot")).applyInArrow(together, "sums binary")
        values = [np.frombuffer(r["sums"]) for r in found.collect()]  # SLOTS rows at most
        return np.sum(values, axis=0)

    return run
