import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import graph_model as GM
from ledgerwatch.operators import sage_training as ST
from ledgerwatch.operators.accounts import ACCOUNT_COLUMNS

WIDTH = len(ACCOUNT_COLUMNS)


def nodes(spark, n=120, seed=1, signal=3.0):
    """Accounts of customers of one to three, some in tier groups; a customer is suspicious as a whole, its first feature says so."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        customer = i // 3 if i % 7 else 1000 + i
        label = int(customer % 4 == 0)
        x = rng.normal(size=WIDTH)
        x[0] += signal * label
        tier = int(rng.integers(0, 4)) if rng.random() < 0.3 else None
        rows.append((f"A{i:04d}", f"customer/C{customer}", tier, label, "train" if i < 0.75 * n else "test", *map(float, x)))
    schema = "account_id string, customer_group string, tier_group int, label int, split string, " + ", ".join(f"`{c}` double" for c in ACCOUNT_COLUMNS)
    return spark.createDataFrame(rows, schema)


def local(parts):
    return lambda function: sum(np.asarray(function(p), np.float64).ravel() for p in parts)


def split_up(spark, monkeypatch, table, part, wide):
    monkeypatch.setattr(ST, "PART", part)
    monkeypatch.setattr(ST, "WIDE", wide)
    stored, names = ST.parts_of(table, ACCOUNT_COLUMNS, 2.5)
    parts = [ST.Part.of(pa.ipc.open_stream(r["part"]).read_all(), names) for r in stored.collect()]
    return stored, names, parts


def loss(weights, parts, names):
    return ST.epoch(local(parts), weights, len(names))[-4]


@pytest.mark.parametrize("part, wide", [(10_000, 10_000), (15, 2)])
def test_gradients_are_those_of_the_loss(spark, monkeypatch, part, wide):
    """By differences, whether groups lie in one part or in many."""
    stored, names, parts = split_up(spark, monkeypatch, nodes(spark), part, wide)
    assert len(parts) == 1 or (len(parts) > 4 and any(n.startswith("customer") for n in names))
    weights = GM.random_weights(3)
    flat = ST.flattened(weights)
    gradient = ST.epoch(local(parts), weights, len(names))[: len(flat)]
    rng = np.random.default_rng(0)
    for i in rng.choice(len(flat), 60, replace=False).tolist():
        ends = []
        for step in (1e-5, -1e-5):
            moved = flat.copy()
            moved[i] += step
            ends.append(loss(ST.shaped(moved, weights), parts, names))
        assert abs((ends[0] - ends[1]) / 2e-5 - gradient[i]) < 1e-5 + 1e-3 * abs(gradient[i])


def test_parts_in_tasks_add_up(spark, monkeypatch):
    table = nodes(spark)
    whole = split_up(spark, monkeypatch, table, 10_000, 10_000)
    stored, names, parts = split_up(spark, monkeypatch, table, 15, 2)
    weights = GM.random_weights(3)
    monkeypatch.setattr(ST, "SLOTS", 2)
    found = [ST.epoch(run, weights, len(n)) for run, n in ((local(whole[2]), whole[1]), (local(parts), names), (ST.summed(stored, names), names))]
    assert np.allclose(found[0], found[1], atol=1e-12) and np.allclose(found[0], found[2], atol=1e-12)


def test_forward_pass_is_that_of_the_scores(spark, monkeypatch):
    table = nodes(spark, 60)
    _, names, parts = split_up(spark, monkeypatch, table, 10, 10_000)
    weights = GM.random_weights(5)
    across = local(parts)(lambda p: p.across(p.first(weights), len(names))).reshape(len(names), -1)
    mine = np.sort(np.concatenate([p.second(weights, p.first(weights), across)[2] for p in parts]))
    scores = np.sort([r.gnn_score for r in GM.sage_forward(table, weights).collect()])
    assert np.allclose(mine, scores, atol=1e-9)


def test_training_beats_the_base_rate_on_held_out_accounts(spark, monkeypatch):
    table = nodes(spark, 400, seed=2)
    _, names, parts = split_up(spark, monkeypatch, table, 10_000, 10_000)
    weights = ST.trained(local(parts), GM.random_weights(1), len(names), 60, 0.02)
    scored = GM.sage_forward(table, weights, ["label", "split"]).where("split = 'test'").select("label", "gnn_score").collect()
    right = np.mean([(r.gnn_score >= 0.5) == (r.label == 1) for r in scored])
    base = max(np.mean([r.label for r in scored]), 1 - np.mean([r.label for r in scored]))
    assert right > base + 0.1
    assert ST.from_json(ST.to_json(weights))[1][0].tolist() == weights[1][0].tolist()


def test_nothing_to_learn_from(spark, monkeypatch):
    table = nodes(spark, 30).withColumn("tier_group", F.lit(None).cast("int")).withColumn("label", F.lit(0))
    _, names, parts = split_up(spark, monkeypatch, table, 10_000, 10_000)
    assert names == {}
    weights = ST.trained(local(parts), GM.random_weights(1), 0, 3)
    assert all(np.isfinite(w).all() for layer in weights for w in layer)
