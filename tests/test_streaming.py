import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from builders import SCHEMA, frame, mismatches, random_rows, replay, txn

from ledgerwatch import schema as S
from ledgerwatch.plans import rules as R
from ledgerwatch.sources import ingest
from ledgerwatch.streaming import features as jobs
from ledgerwatch.streaming import flags, lines, state


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Map(dict):
    reads = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        Map.reads += 1
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()


def customer(rows, sizes, lateness=None):
    """Rows of one customer through the state in batches of ``sizes``."""
    processor = state.CustomerState(lateness)
    processor.init(Handle())
    out, at = [], 0
    for size in sizes:
        part = rows[at : at + size]
        at += size
        table = pd.DataFrame([{
            "transaction_id": r[0], "account_id": r[1], "channel": r[6], "ts_us": (r[9] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1),
            "amount_minor": round(r[4] * 100), "arrival_seq": r[10], "event_hour": r[9].hour, "round_amount": int(int(r[4]) % 10000 == 0)} for r in part])
        table = table.sample(frac=1, random_state=size)  # a batch comes in any order
        out += [d for f in processor.handleInputRows(("+C",), iter([table[:2], table[2:]]), None) for d in f.to_dict("records")]
    assert at == len(rows)
    return {r["transaction_id"]: r for r in out}, processor


@pytest.mark.parametrize("seed, disorder, block", [(1, 0, 256), (2, 400_000, 256), (3, 2_000_000, 4), (4, 100_000, 1)])
def test_state_of_a_customer_by_definition(monkeypatch, seed, disorder, block):
    monkeypatch.setattr(state, "BLOCK", block)
    rows = random_rows(120, ["C1"], seed, disorder, tie=seed == 3)
    rng = random.Random(seed)
    sizes = []
    while sum(sizes) < len(rows):
        sizes.append(min(rng.choice([1, 3, 17, 40]), len(rows) - sum(sizes)))
    want = replay(rows)
    got, _ = customer(rows, sizes)
    by_id = {r[0]: r for r in rows}
    for t, w in want.items():
        g = got[t]
        assert (g["n_1h"], g["n_24h"], g["n_60s"], g["round_24h"], g["accounts_24h"], g["accounts_per_customer"]) == (
            w["count_1h"], w["count_24h"], w["n_60s"], w["round_24h"], w["unique_counterparties_24h"], w["accounts_per_customer"])
        assert [g["s_1h"], g["s_6h"], g["s_24h"], g["s_7d"], g["max_24h"]] == [
            round(100 * w[c]) for c in ("sum_1h", "cross_account_sum_6h", "sum_24h", "sum_7d", "max_single_24h")]
        assert (by_id[t][6] == g["usual_channel"]) == w["channel_consistency"]


def test_late_rows_change_nothing_and_old_hours_go():
    rows = random_rows(300, ["C1"], 9)  # half an hour apart
    old = txn(1000, 0, 77.0)
    got, processor = customer([*rows, old, txn(1001, 300 * 1800)], [100, 100, 100, 1, 1], lateness=S.DAY)
    assert got["T1000"]["late"] and got["T1000"]["n_24h"] is None and got["T1001"]["txns_so_far"] == 301
    assert [got[r[0]]["s_7d"] for r in rows] == [customer(rows, [300])[0][r[0]]["s_7d"] for r in rows]
    assert len(processor.sums) == len(processor.events) <= (S.WEEK + S.DAY) // S.HOUR + 2


def test_a_batch_reads_only_hours_in_which_windows_begin():
    rows = random_rows(2000, ["C1"], 5)
    _, processor = customer(rows[:1990], [1990])
    Map.reads = 0
    processor.windows_of(np.array([10**15 * 3]), np.array([5]), np.array([0]))
    assert Map.reads == 0
    got, _ = customer(rows, [1990, 10])
    assert got[rows[-1][0]]["n_24h"] == replay(rows)[rows[-1][0]]["count_24h"]


def test_a_customer_of_few_rows_costs_few_calls_of_the_state(monkeypatch):
    calls = []
    for kind, names in ((Value, ("exists", "get", "update")), (Map, ("containsKey", "getValue", "updateValue", "iterator"))):
        for name in names:
            monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name): (calls.append(f), f(self, *a))[1])
    rows = random_rows(240, ["C1"], 5)
    customer(rows, [10] * 24)
    assert len(calls) <= 4 * 24


@pytest.mark.parametrize("lateness", [None, S.DAY])
def test_a_customer_that_outgrows_one_value_is_answered_alike(monkeypatch, lateness):
    monkeypatch.setattr(Value, "clear", lambda self: self.update(None), raising=False)
    rows = [(*r[:1], None if i % 7 == 0 else r[1], *r[2:6], None if i % 11 == 0 else r[6], *r[7:]) for i, r in enumerate(random_rows(240, ["C1"], 6, 400_000))]
    found = []
    for whole in (10**6, 100, 0):
        monkeypatch.setattr(state, "WHOLE", whole, raising=False)
        got, processor = customer(rows, [10] * 24, lateness)
        found.append(got)
        if lateness is None:  # else too many rows are late to outgrow it
            assert (len(processor.sums) > 0) == (whole < 240) == (processor.whole.held is None)
    assert found[0] == found[1] == found[2] and len(found[0]) == 240


def put(spark, folder, rows, batch):
    """One file of the stream's source, newer than those before."""
    path = f"{folder}/in"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).transform(ingest.complete).write.mode("append").parquet(path)
    return path


def source(spark, folder):
    schema = frame(spark, [txn(1, 0)]).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_stream_equals_replay_over_a_restart(spark, folder):
    rows = random_rows(150, ["C1", "C1", "C2", None], seed=21, disorder=400_000, tie=True)
    job = jobs.FeatureStream(folder, lateness=None)
    for part in (rows[:50], rows[50:80]):
        put(spark, folder, part, 0)
    jobs.feature_batches(source(spark, folder), job, f"{folder}/checkpoint").awaitTermination()
    assert jobs.read_features(spark, folder).count() == 80
    put(spark, folder, rows[80:], 1)
    query = jobs.feature_batches(source(spark, folder), job, f"{folder}/checkpoint")
    query.awaitTermination()
    assert mismatches(jobs.read_features(spark, folder), replay(rows)) == []
    assert jobs.read_features(spark, folder, late=True).count() == 0
    assert "rocksdbGetCount" in query.lastProgress.json


def test_a_small_batch_reads_the_state_of_its_customers_only(spark, folder):
    """Reads follow the customers in the batch, not those in the state; late rows are kept apart."""
    many = [txn(i, 60 * i, customer=f"C{i}", account=f"A{i}") for i in range(600)]
    few = [txn(1000 + i, 90_000 + i, customer=f"C{i}", account=f"A{i}") for i in range(10)]
    late = [txn(2000, 0, customer="C3")]
    job = jobs.FeatureStream(folder, lateness=S.HOUR)
    gets = []
    for part in (many, few, late):
        put(spark, folder, part, 0)
        query = jobs.feature_batches(source(spark, folder), job, f"{folder}/checkpoint")
        query.awaitTermination()
        progress = next(p for p in reversed(query.recentProgress) if p.numInputRows)
        gets.append(progress.stateOperators[0].customMetrics["rocksdbGetCount"])
    assert gets[1] * 20 < gets[0]
    assert jobs.read_features(spark, folder).where("txns_so_far = 2").count() == 10
    assert [r.transaction_id for r in jobs.read_features(spark, folder, late=True).collect()] == ["T2000"]


def lines_of(spark, folder, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "value string, arrival_seq bigint").coalesce(1).write.mode("append").parquet(f"{folder}/lines")
    return spark.readStream.schema("value string, arrival_seq bigint").option("maxFilesPerTrigger", 1).parquet(f"{folder}/lines")


def test_bad_lines_cost_no_good_ones(spark, folder):
    good = '{"transaction_id": "T%d", "customer_id": "C", "amount": %s, "timestamp": "%s"}'
    parts = [
        [(good % (1, "5.5", "2026-07-04T19:01:05Z"), 1), ("not json", 2), ("  ", 3), ('{"transaction_id": "T4", "amount": 1}', 4)],
        [(good % (5, "1e300", "2026-07-04T19:01:05Z"), 5), (good % (6, '"much"', "2026-07-04T19:01:05Z"), 6), (good % (7, "7", "yesterday"), 7),
         (None, 8), (good % (9, "null", "2026-07-04T19:01:06Z"), 9), (good % (10, '"NaN"', "2026-07-04T19:01:05Z"), 10)],
    ]
    query = lines.route_batches(lines_of(spark, folder, parts), f"{folder}/out", f"{folder}/checkpoint", on_bad_ts="drop")
    query.awaitTermination()
    assert sorted(r.transaction_id for r in lines.accepted(spark, f"{folder}/out").collect()) == ["T1", "T9"]
    why = {r.arrival_seq: (r.reason, r.value) for r in lines.rejected(spark, f"{folder}/out").collect()}
    assert {k: v[0] for k, v in why.items()} == {2: "malformed", 4: "no_customer", 5: "bad_amount", 6: "malformed", 7: "bad_time", 10: "bad_amount"}
    assert why[2][1] == "not json"
    again = lines.route_batches(lines_of(spark, folder, []), f"{folder}/out", f"{folder}/checkpoint", on_bad_ts="drop")
    again.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 8


def test_open_windows_appear_and_are_replaced(spark, folder):
    hour = 3600
    parts = [
        [txn(1, 0, 90_000, kind="withdrawal", channel="ATM"), txn(2, 60, 20_000, kind="withdrawal", channel="ATM")],
        [txn(3, 120, 5, kind="withdrawal", channel="ATM"), *[txn(10 + i, hour + i, 10.0) for i in range(5)]],
        [txn(20, hour + 30, 900_000), txn(4, 180, -50_000, kind="withdrawal", channel="ATM")],  # a mean rises, a sum falls
    ]
    seen = []
    for i, part in enumerate(parts):
        put(spark, folder, part, i)
        flags.flag_batches(source(spark, folder), R.PRODUCTION, f"{folder}/flags", f"{folder}/checkpoint", lateness=S.WEEK).awaitTermination()
        batch = frame(spark, [r for p in parts[: i + 1] for r in p])
        got = sorted(map(tuple, flags.current_flags(spark, f"{folder}/flags").collect()), key=repr)
        assert got == sorted(map(tuple, R.flagged(batch, R.PRODUCTION).collect()), key=repr)
        seen.append({r[4] for r in got})
    assert "DAILY_ATM_BREACH" in seen[0] and "TRANSFER_VELOCITY" in seen[1] and not {"DAILY_ATM_BREACH", "TRANSFER_VELOCITY"} & seen[2]


def test_closed_windows_are_appended(spark, folder):
    put(spark, folder, [txn(i, i, 60_000, kind="withdrawal", channel="ATM") for i in range(3)], 0)
    put(spark, folder, [txn(9, 40 * 86_400, 1.0)], 1)
    out = flags.flagged(source(spark, folder), R.PRODUCTION)
    flags.write_flags(out, f"{folder}/flags", f"{folder}/checkpoint").awaitTermination()
    found = {r.rule_triggered for r in spark.read.schema(out.schema).parquet(f"{folder}/flags").collect()}
    assert {"DAILY_ATM_BREACH", "BURST_PATTERN"} <= found
