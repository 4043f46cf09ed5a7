"""Hand-made transactions and a row-by-row replay of the feature definitions."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from ledgerwatch.sources.ingest import complete

SCHEMA = (
    "transaction_id string, account_id string, customer_id string, account_tier string, amount double, type string, "
    "channel string, is_suspicious boolean, suspicious_typology string, event_ts timestamp_ntz, arrival_seq bigint"
)
DAY0 = dt.datetime(2026, 3, 2)


def txn(seq, at, amount=100.0, account="A1", customer="C1", tier="TIER_2", kind="transfer", channel="mobile", suspicious=False, typology=None):
    ts = at if isinstance(at, dt.datetime) else DAY0 + dt.timedelta(seconds=at)
    return (f"T{seq}", account, customer, tier, float(amount), kind, channel, suspicious, typology, ts, seq)


def frame(spark, rows):
    return complete(spark.createDataFrame(rows, SCHEMA))


def random_rows(n, customers, seed, disorder=0, tie=False):
    """Rows in arrival order; ``disorder`` seconds of random delay, ``tie`` for coarse clock values."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        c = rng.choice(customers)
        at = seq * 1800 - rng.randint(0, disorder)
        if tie:
            at -= at % 7200
        rows.append(
            txn(
                seq, at, round(rng.choice([rng.uniform(0, 500), rng.uniform(1e4, 4e6), 10000.0, 0.0]), 2), f"{c}-{rng.randint(1, 3)}", c,
                rng.choice(["TIER_1", "TIER_2", "TIER_3", "TIER_9"]), rng.choice(["transfer", "withdrawal", "airtime", "loan"]),
                rng.choice(["ATM", "POS", "mobile", "USSD", "branch"]), rng.random() < 0.1,
            )
        )
    return rows


def replay(rows, order="arrival"):
    """Features by definition: every row looks at all rows of its customer so far."""
    if order == "event_time":
        rows = sorted(rows, key=lambda r: (r[9], r[10]))
    seen, result = {}, {}
    for r in rows:
        past = seen.setdefault(r[2], [])
        past.append(r)
        now, amount = r[9], r[4]
        hours = lambda h: [x for x in past if x[9] >= now - dt.timedelta(hours=h)]

        def usual(values):
            return max(dict.fromkeys(values), key=values.count)

        amounts = [x[4] for x in past]
        mean = sum(amounts) / len(amounts)
        std = 1.0
        if len(set(amounts)) > 1:
            std = math.sqrt(sum((a - mean) ** 2 for a in amounts) / len(amounts))
        day = [x[4] for x in hours(24)]
        day_mean = sum(day) / len(day)
        day_std = math.sqrt(sum((a - day_mean) ** 2 for a in day) / len(day))
        result[r[0]] = {
            "inter_txn_interval_seconds": (now - past[-2][9]).total_seconds() if len(past) > 1 else -1.0,
            "count_1h": len(hours(1)), "count_24h": len(day), "n_60s": len(hours(1 / 60)),
            "sum_1h": sum(x[4] for x in hours(1)), "cross_account_sum_6h": sum(x[4] for x in hours(6)),
            "sum_24h": sum(day), "sum_7d": sum(x[4] for x in hours(168)),
            "max_single_24h": max(day), "cov_24h": day_std / max(day_mean, 1) if len(day) > 1 else 0.0,
            "amount_vs_customer_mean": amount / max(mean, 1), "amount_zscore": (amount - mean) / std,
            "channel_consistency": int(r[6] == usual([x[6] for x in past])),
            "hour_consistency": int(abs(now.hour - usual([x[9].hour for x in past])) <= 2),
            "accounts_per_customer": len({x[1] for x in past}),
            "account_age_days": (now - past[0][9]).days,
            "unique_counterparties_24h": len({x[1] for x in hours(24)}),
            "round_24h": sum(1 for x in hours(24) if int(x[4]) % 10000 == 0),
        }
    return result


def mismatches(df, expected):
    got = {r["transaction_id"]: r.asDict() for r in df.collect()}
    assert set(got) == set(expected)
    return [
        (t, c, got[t][c], v)
        for t, values in expected.items()
        for c, v in values.items()
        if not math.isclose(got[t][c], v, rel_tol=1e-8, abs_tol=1e-6)
    ]
