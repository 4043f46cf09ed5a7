import pytest
from builders import frame, mismatches, random_rows, replay, txn

from ledgerwatch.operators import features as FT

# Small limits force the segmented plans, so that several segments meet inside every window.
TINY = dict(max_rows=1, max_rows_per_week=1, rows_per_segment=25)
CUSTOMERS = ["C1", "C1", "C1", "C2", "C3"]


@pytest.mark.parametrize("sizes", [{}, TINY], ids=["ordinary", "segmented"])
def test_event_time_equals_replay(spark, sizes):
    rows = random_rows(220, CUSTOMERS, seed=1, disorder=90_000, tie=True)
    result = FT.features(frame(spark, rows), "event_time", **sizes)
    assert mismatches(result, replay(rows, "event_time")) == []


@pytest.mark.parametrize("sizes", [{}, TINY], ids=["ordinary", "segmented"])
def test_arrival_equals_replay(spark, sizes):
    rows = random_rows(220, CUSTOMERS, seed=2, disorder=400_000, tie=True)
    result = FT.features(frame(spark, rows), "arrival", **sizes)
    assert mismatches(result, replay(rows, "arrival")) == []


def test_only_hot_customers_are_segmented(spark):
    rows = random_rows(150, CUSTOMERS, seed=3)
    limits = dict(max_rows=60, max_rows_per_week=10_000, rows_per_segment=20)
    ordinary, hot = FT.split_by_size(frame(spark, rows), 60, 10_000)
    assert {r[0] for r in hot.select("customer_id").distinct().collect()} == {"C1"}
    assert ordinary.count() + hot.count() == 150
    assert mismatches(FT.features(frame(spark, rows), **limits), replay(rows, "event_time")) == []


def test_one_shuffle_for_ordinary_customers(spark):
    """All windows of the table share one exchange on the customer."""
    df = FT.feature_matrix(frame(spark, random_rows(30, CUSTOMERS, seed=4)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(customer_id") == 1 and plan.count("Exchange") == 1


def feature_rows(spark, rows, order="arrival"):
    return {r["transaction_id"]: r for r in FT.features(frame(spark, rows), order).collect()}


def test_ties_exclude_later_peers(spark):
    for order in ("arrival", "event_time"):
        got = feature_rows(spark, [txn(1, 0, 10), txn(2, 0, 20)], order)
        assert (got["T1"]["sum_24h"], got["T2"]["sum_24h"]) == (10, 30)


def test_out_of_order(spark):
    got = feature_rows(spark, [txn(1, 36000), txn(2, 32400), txn(3, 41400)])
    assert got["T2"]["inter_txn_interval_seconds"] == -3600
    assert got["T2"]["count_1h"] == 2  # the row at 10:00 has arrived already
    assert got["T2"]["account_age_days"] == -1


def test_cutoffs_are_closed(spark):
    import datetime as dt

    from builders import DAY0

    at = lambda s, us=0: DAY0 + dt.timedelta(seconds=s, microseconds=us)
    hour, day, week = 3600, 86400, 604800
    got = feature_rows(spark, [txn(1, at(0)), txn(2, at(hour)), txn(3, at(hour, 1)), txn(4, at(day)), txn(5, at(day, 1)), txn(6, at(week)), txn(7, at(week, 1))])
    assert [got[f"T{i}"]["count_1h"] for i in (2, 3)] == [2, 2]
    assert [got[f"T{i}"]["count_24h"] for i in (4, 5)] == [4, 4]
    assert [got[f"T{i}"]["sum_7d"] for i in (6, 7)] == [600, 600]


def test_guards(spark):
    got = feature_rows(spark, [txn(1, 0, 0), txn(2, 60, 0.5), txn(3, 0, 7, customer="C2"), txn(4, 9, 7, customer="C2")])
    assert got["T1"]["amount_roundness"] == 1 and got["T1"]["cov_24h"] == 0 and got["T1"]["inter_txn_interval_seconds"] == -1
    assert got["T2"]["amount_vs_customer_mean"] == 0.5  # mean below one counts as one
    assert got["T4"]["amount_zscore"] == 0


def test_mode_ties_go_to_the_value_seen_first(spark):
    rows = [txn(i, i, channel=c) for i, c in enumerate(["POS", "ATM", "ATM", "POS"])]
    got = feature_rows(spark, rows)
    assert [got[f"T{i}"]["channel_consistency"] for i in range(4)] == [1, 0, 1, 1]
    late, early = 23 * 3600, 24 * 3600
    got = feature_rows(spark, [txn(1, late), txn(2, early)])
    assert got["T2"]["hour_consistency"] == 0  # 0 and 23 are far apart


def test_half_hundreds_round_to_even(spark):
    got = feature_rows(spark, [txn(1, 0, 50), txn(2, 1, 150), txn(3, 2, 250)])
    assert [round(got[f"T{i}"]["amount_roundness"], 6) for i in (1, 2, 3)] == [0.0, round(1 - 50 / 150, 6), 0.8]
