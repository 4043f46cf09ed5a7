"""Graph scores of accounts: two layers of neighbour averaging, trained over the whole graph."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite_or
from ..session import cut_lineage
from . import sage_training as training
from .accounts import ACCOUNT_COLUMNS
from .graph import members, neighbor_mean
from .metrics import class_weights, node_split
from .scaling import Scaler

# Layer sizes and the suspicion threshold.
HIDDEN = (64, 32)
SUSPICIOUS_FROM = 0.3
KEYS = ["account_id", "customer_group", "tier_group"]


def scaled_nodes(accounts: DataFrame, coordinated: bool = True) -> DataFrame:
    """Group membership, split, label and scaled features per account; non-finite values are zero."""
    nodes = node_split(cut_lineage(members(accounts, coordinated)))
    return scaled(nodes, Scaler.fit(nodes, ACCOUNT_COLUMNS), "label", "split")


def scaled(nodes: DataFrame, scaler: Scaler, *kept: str) -> DataFrame:
    clean = [finite_or(e, 0.0).alias(c) for e, c in zip(scaler.expressions(), scaler.columns)]
    return nodes.select(*KEYS, *kept, *clean)


def random_weights(seed: int = 42, inputs: int = len(ACCOUNT_COLUMNS)) -> list[tuple]:
    """Glorot-uniform weights (neighbour matrix, own matrix, bias) per layer, then the classifier."""
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6.0 / (a + b))
    first, second = HIDDEN
    return [
        (draw(inputs, first), draw(inputs, first), np.zeros(first)),
        (draw(first, second), draw(first, second), np.zeros(second)),
        (draw(second, 2), np.zeros(2)),
    ]


def sage_forward(nodes: DataFrame, weights: list[tuple], kept: list[str] | None = None) -> DataFrame:
    """Mean-aggregating GraphSAGE (Hamilton et al. 2017): per layer
    relu(W1 mean(neighbours and self) + W2 own + b), then a softmax. Neighbour means are group
    totals; only the dense algebra runs in Python, on fixed-size weights."""
    spark = nodes.sparkSession
    columns = ACCOUNT_COLUMNS
    keys = [*KEYS, *(kept or [])]
    current = nodes.select(*keys, *columns)
    for depth, layer in enumerate(weights[:-1]):
        shared = spark.sparkContext.broadcast(layer)
        width = layer[0].shape[1]
        current = neighbor_mean(current, columns).select(
            *keys, F.array(*[f"mean_{c}" for c in columns]).alias("near"), F.array(*columns).alias("own")
        )
        dense = _dense(shared)
        current = cut_lineage(current.select(*keys, dense("near", "own").alias("h")))
        columns = [f"h{depth}_{i}" for i in range(width)]
        current = current.select(*keys, *[F.col("h")[i].alias(c) for i, c in enumerate(columns)])
    last = spark.sparkContext.broadcast(weights[-1])

    @F.pandas_udf("double")
    def softmax(own: pd.Series) -> pd.Series:
        w, b = last.value
        out = np.vstack(own.to_numpy()) @ w + b
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return pd.Series(out[:, 1] / out.sum(axis=1))

    return current.select("account_id", *(kept or []), finite_or(softmax(F.array(*columns)), 0.5).alias("gnn_score"))


def _dense(shared):
    @F.pandas_udf("array<double>")
    def dense(near: pd.Series, own: pd.Series) -> pd.Series:
        w1, w2, b = shared.value
        out = np.vstack(near.to_numpy()) @ w1 + np.vstack(own.to_numpy()) @ w2 + b
        return pd.Series(list(np.maximum(out, 0.0)))

    return dense


@dataclass(frozen=True)
class GraphModel:
    """Trained weights of both layers and the classifier, with the scaler of the training accounts."""

    scaler: Scaler
    weights: list[tuple]

    def probabilities(self, nodes: DataFrame) -> DataFrame:
        return sage_forward(nodes, self.weights, [c for c in ("label", "split") if c in nodes.columns])

    def serve(self, accounts: DataFrame) -> DataFrame:
        """Scores of accounts with the serving vector: neighbours are the customer's own accounts only. Accounts
        that are not among these get the neutral score where scores are joined."""
        return self.probabilities(scaled(cut_lineage(members(accounts, coordinated=False)), self.scaler))

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"scaler": self.scaler.to_json(), "weights": training.to_json(self.weights)})
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "GraphModel":
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return GraphModel(Scaler.from_json(found["scaler"]), training.from_json(found["weights"]))


def fit_graph(accounts: DataFrame, seed: int = 42, epochs: int = 60, rate: float = 0.02) -> tuple[GraphModel, DataFrame]:
    """The model, and the scaled accounts with label and split that it was trained on: the earlier ones, the suspicious of
    them by their capped weight."""
    nodes = node_split(cut_lineage(members(accounts)))
    scaler = Scaler.fit(nodes, ACCOUNT_COLUMNS)
    nodes = cut_lineage(scaled(nodes, scaler, "label", "split"))
    weight = class_weights(nodes.where("split = 'train'"), "label")["graph_suspicious"]
    parts, wide = training.parts_of(nodes, ACCOUNT_COLUMNS, weight)
    weights = training.trained(training.summed(parts, wide), random_weights(seed), len(wide), epochs, rate)
    return GraphModel(scaler, weights), nodes


def graph_scores(accounts: DataFrame, seed: int = 42, epochs: int = 60) -> DataFrame:
    """Suspicion probability per account, by a model trained on the earlier accounts."""
    model, nodes = fit_graph(accounts, seed, epochs)
    return model.probabilities(nodes).withColumn("prediction", (F.col("gnn_score") >= SUSPICIOUS_FROM).cast("int"))
