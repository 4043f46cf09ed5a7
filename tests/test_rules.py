import datetime as dt

from builders import DAY0, frame, txn

from ledgerwatch import schema as S
from ledgerwatch.operators import features as FT
from ledgerwatch.plans import rules as R
from ledgerwatch.plans import scoring as SC


def flags(df):
    return sorted((r["rule_triggered"], r["account_id"], r["flagged_amount"], r["txn_count"]) for r in df.collect())


def test_single_pass_equals_rule_by_rule(spark):
    from builders import random_rows

    txns = frame(spark, random_rows(400, ["C1", "C2", "C3"], seed=7))
    for profile in R.PROFILES.values():
        one_by_one = [f for rule in profile for f in flags(R.rule(txns, rule))]
        assert flags(R.flagged(txns, profile)) == sorted(one_by_one)


def test_single_pass_reads_once(spark):
    from builders import random_rows

    plan = R.flagged(frame(spark, random_rows(20, ["C1"], seed=7)), R.PRODUCTION)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan") == 1


def test_burst_and_velocity_production(spark):
    burst = [txn(i, i * 11, 10, kind="airtime") for i in range(5)]
    small = [txn(10 + i, 7200 + i * 600, 99_999, account="A2") for i in range(5)]
    large = [txn(20 + i, 7200 + i * 600, 100_000, account="A3") for i in range(5)]
    got = flags(R.flagged(frame(spark, burst + small + large), R.PRODUCTION))
    assert ("BURST_PATTERN", "A1", 50.0, 5) in got
    assert [g[1] for g in got if g[0] == "TRANSFER_VELOCITY"] == ["A2"]


def test_round_amounts_truncate(spark):
    rows = [txn(i, i, a) for i, a in enumerate([10000.75, 20000.0, 0.5])]
    assert ("ROUND_AMOUNT_PATTERN", "A1", 30001.25, 3) in flags(R.flagged(frame(spark, rows), R.PRODUCTION))


def test_edges_and_alignment(spark):
    rows = [txn(i, 60, 10) for i in range(3)]
    rule = R.find(R.PRODUCTION, "BURST_PATTERN")
    end = lambda **kw: [r["detected_at"] for r in R.rule(frame(spark, rows), rule, **kw).collect()]
    assert end() == [DAY0 + dt.timedelta(seconds=120)]
    assert end(closed="right") == [DAY0 + dt.timedelta(seconds=60)]
    weekly = R.find(R.PRODUCTION, "WEEKLY_WITHDRAWAL_BREACH")
    one = frame(spark, [txn(1, dt.datetime(2026, 7, 5, 12), 600_000, kind="withdrawal")])
    assert R.rule(one, weekly).first()["detected_at"] == dt.datetime(2026, 7, 9)
    assert R.rule(one, weekly, offset=4 * S.DAY).first()["detected_at"] == dt.datetime(2026, 7, 6)


def test_transaction_rules(spark):
    rows = [txn(i, i * 10, 10_000) for i in range(5)] + [txn(9, 60, 4_600_000, tier="TIER_1", channel="ATM", kind="withdrawal")]
    got = {r[0]: r[1] for r in FT.features(frame(spark, rows)).select("transaction_id", SC.triggered_rules()).collect()}
    assert got["T4"] == ["BURST_PATTERN", "TRANSFER_VELOCITY", "ROUND_AMOUNT_PATTERN"]
    assert got["T9"] == [
        "NFIU_THRESHOLD_APPROACH", "DAILY_ATM_BREACH", "BURST_PATTERN", "STRUCTURING_DETECTED", "WEEKLY_WITHDRAWAL_BREACH", "KYC_TIER1_BREACH",
    ]


def test_golden_alert(spark):
    rows = spark.sql(
        "SELECT 'T' AS transaction_id, 'A' AS account_id, 'C' AS customer_id, CAST(NULL AS STRING) AS account_tier, 2549429.59D AS amount, "
        "timestamp_ntz'2026-07-04 19:01:05.749530' AS event_ts, .3787D AS iso_score, .9639D AS rf_score, 1D AS gnn_score, "
        "array('NFIU_THRESHOLD_APPROACH', 'BURST_PATTERN') AS triggered_rules"
    )
    alert = SC.score_rows(rows).first()
    assert (alert["risk_score"], alert["risk_tier"], alert["account_tier"]) == (89.2, "HIGH", "UNKNOWN")
    assert alert["timestamp"] == "2026-07-04T19:01:05.749530Z"
    assert alert["recommended_action"] == "Escalate to MLRO. File STR with NFIU within 7 days."


def test_score_is_rounded_before_the_tier(spark):
    rows = spark.sql("SELECT 0.3996D AS iso_score, 0.3996D AS rf_score, 0.3996D AS gnn_score")
    assert SC.fuse(rows).first()[3:] == (40.0, "MEDIUM")


def test_regulation_without_or_with_unknown_rule(spark):
    rows = spark.sql("SELECT 1 AS id, array() :: array<string> AS triggered_rules UNION ALL SELECT 2, array('OTHER')")
    texts = {r["id"]: r["recommended_action"] for r in SC.with_regulation(rows).collect()}
    assert texts[1].startswith("Enhanced monitoring") and texts[2].startswith("Review and escalate")
