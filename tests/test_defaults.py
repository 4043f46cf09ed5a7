"""Whole results where fields are missing, rows are late or repeated, and keys fill their range."""

import math
from types import SimpleNamespace

import pytest
from builders import frame, random_rows, txn
from pyspark.sql import functions as F

from ledgerwatch import session
from ledgerwatch.operators import accounts as A
from ledgerwatch.operators import evidence as E
from ledgerwatch.operators import features as FT
from ledgerwatch.operators import graph_model as GM
from ledgerwatch.operators import metrics as M
from ledgerwatch.operators import models as MD
from ledgerwatch.plans import scoring as SC
from ledgerwatch.sources import sinks
from ledgerwatch.streaming import features as stream_jobs



def with_scores(rows):
    return rows.withColumns({c: F.lit(0.5).cast("decimal(6,4)") for c in ("iso_score", "rf_score", "gnn_score")})


def stored(spark, rows, path, **fields):
    extra = {"currency": F.lit("NGN"), "location": F.lit("Lagos"), "balance_after": F.lit(1.0), **fields}
    sinks.write_transactions(frame(spark, rows).withColumns(extra), path)
    return {r["transaction_id"]: r["amount"] for r in sinks.read_transactions(spark, path).collect()}


def test_upsert_keeps_other_rows_of_a_day(spark, folder):
    path = f"{folder}/t"
    assert stored(spark, [txn(1, 0, 10), txn(2, 60, 20)], path) == {"T1": 10, "T2": 20}
    assert stored(spark, [txn(3, 120, 30)], path) == {"T1": 10, "T2": 20, "T3": 30}
    assert stored(spark, [txn(2, 60, 25), txn(4, 200_000, 40)], path) == {"T1": 10, "T2": 25, "T3": 30, "T4": 40}
    # A corrected time moves the row.
    assert stored(spark, [txn(4, 400_000, 41)], path) == {"T1": 10, "T2": 25, "T3": 30, "T4": 41}
    assert sinks.read_transactions(spark, path).select(F.to_date("txn_timestamp")).distinct().count() == 2


@pytest.mark.parametrize("n", [999_999, 1_000_000, 1_000_001, 5_000_000_000])
def test_deviation_of_nearly_constant_amounts(spark, n):
    """All amounts but one are 1,000,000.00; that one is a kobo more."""
    base = 100_000_000
    total, squares = n * base + 1, (n - 1) * base * base + (base + 1) ** 2
    row = spark.range(1).select(FT.std_from_sums(
        F.lit(n), F.lit(total), F.lit(str(squares)).cast("decimal(38,0)")).alias("std")).first()
    assert math.isclose(row["std"], math.sqrt((n - 1) / n / n) / 100, rel_tol=1e-9)


def test_order_statistics_of_hash_values(spark):
    values = sorted(r["v"] for r in spark.range(3000).select(F.xxhash64("id").alias("v")).collect())
    df = spark.range(3000).select(F.xxhash64("id").alias("v"))
    assert M.order_statistics(df, "v", [1, 777, 3000], k=200, small=0) == [values[0], values[776], values[2999]]


def test_oversampling_from_bounded_seeds(spark):
    rows = [(f"r{i}", [float(i), float(i * i % 7)], int(i < 30)) for i in range(100)]
    data = SimpleNamespace(train=spark.createDataFrame(rows, "id string, x array<double>, label int"))
    for seeds in (100, 10):
        out = MD.oversample(data, k=3, seeds=seeds)
        assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 70, 1: 70}
        assert out.join(data.train, "id", "left_semi").count() == 100


def missing(spark):
    rows = [txn(i, 60 * i, 200_000, kind=None, channel=None, tier=None) for i in range(5)]
    rows.append(txn(9, 1000, 10_000, customer=None, kind="withdrawal", channel="ATM"))
    return frame(spark, rows)


def test_missing_fields_fire_the_same_rules_in_batch_and_stream(spark, folder):
    wide = FT.features(SC.scoring_input(missing(spark)), "arrival", keep=list(SC.REPORTED))
    table = SC.score_rows(with_scores(wide).withColumn("triggered_rules", SC.triggered_rules())).orderBy("arrival_seq")
    scored, scored_counts = table.collect(), SC.summary(table).first().asDict()
    assert {"TRANSFER_VELOCITY", "ROUND_AMOUNT_PATTERN"} <= set(scored[4]["triggered_rules"])
    assert [r["account_tier"] for r in scored] == ["UNKNOWN"] * 5 + ["TIER_2"] and scored[5]["customer_id"] == "UNKNOWN"

    batch = missing(spark)
    batch.repartition(1).write.parquet(f"{folder}/in")
    job = stream_jobs.FeatureStream(f"{folder}/job")
    source = spark.readStream.schema(batch.schema).parquet(f"{folder}/in")
    counters = stream_jobs.RunCounters()
    spark.streams.addListener(counters)
    query = stream_jobs.score_batches(source, job, with_scores, f"{folder}/checkpoint")
    query.awaitTermination()
    counters.wait(query)
    spark.streams.removeListener(counters)
    assert counters.totals() == {c: scored_counts[c] for c in counters.totals() if c != "late"} | {"late": 0}
    # Fields that the stream lacks take the stored defaults.
    kept = {r["transaction_id"]: r for r in sinks.read_transactions(spark, f"{folder}/job/transactions").collect()}
    assert len(kept) == 6 and (kept["T9"]["customer_id"], kept["T9"]["currency"], kept["T1"]["txn_type"], kept["T1"]["is_suspicious"]) == ("UNKNOWN", "NGN", "transfer", False)
    alerts = spark.read.parquet(f"{folder}/job/alerts").orderBy("arrival_seq").collect()
    assert [r["triggered_rules"] for r in alerts] == [r["triggered_rules"] for r in scored if r["risk_score"] >= 40]
    assert [r["customer_id"] for r in stream_jobs.current_snapshots(spark, f"{folder}/job").collect()] == ["C1"]


def test_reports_of_customers_without_history(spark):
    alerts = spark.createDataFrame([("T1", "A9", "C9", 90.0), ("T2", "A1", "C1", 80.0)], "transaction_id string, account_id string, customer_id string, risk_score double")
    notes = spark.createDataFrame([("T1", "p", "c", "dismiss", "d")], "transaction_id string, pattern_analysis string, cross_account_analysis string, risk_assessment string, str_draft string")
    reports = {r["transaction_id"]: r for r in E.case_report(alerts, frame(spark, [txn(2, 0)]), notes).collect()}
    assert reports["T1"]["history"] == E.NO_HISTORY and reports["T1"]["all_accounts"] == []
    assert reports["T2"]["all_accounts"] == ["A1"] and reports["T2"]["history"].startswith("Total transactions: 1")


def test_a_shared_folder_is_asked_for_on_clusters():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_reloaded_graph_model_serves_the_same_scores(spark, folder):
    wide = FT.features(frame(spark, random_rows(200, [f"C{i}" for i in range(20)], seed=31)))
    model, _ = GM.fit_graph(A.account_features(wide), epochs=5)
    serving = A.account_features_serving(wide)
    model.save(spark, folder)
    first = {r["account_id"]: r["gnn_score"] for r in model.serve(serving).collect()}
    again = {r["account_id"]: r["gnn_score"] for r in GM.GraphModel.load(spark, folder).serve(serving).collect()}
    assert first == again and len(first) == serving.count() and all(0 <= v <= 1 for v in first.values())
