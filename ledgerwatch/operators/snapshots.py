"""Customer snapshots: one mergeable row per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def delta(scored: DataFrame) -> DataFrame:
    """Mergeable aggregate of scored transactions. ``first``/``latest`` follow arrival order.

    Two levels: per customer and account first, so that the account list of a customer is built
    from one row per account.
    """
    position = F.col("arrival_seq")
    is_alert = F.col("risk_score") >= S.ALERT_SCORE
    risk = F.struct("risk_score", "risk_tier")
    by_account = scored.groupBy("customer_id", "account_id").agg(
        F.count("*").alias("n"),
        F.sum("amount_minor").alias("total_minor"),
        F.max("amount").alias("largest"),
        F.count_if("is_suspicious").alias("suspicious"),
        F.count_if(is_alert).alias("alerts"),
        F.max(F.when(is_alert, F.struct("arrival_seq", "risk_score", "risk_tier"))).alias("latest_alert"),
        F.max(F.when(is_alert, F.col("risk_score"))).alias("highest_alert"),
        F.min_by(F.struct("arrival_seq", "risk_score", "risk_tier", "account_tier", "event_ts"), position).alias("first"),
        F.max_by(F.struct("arrival_seq", "event_ts"), position).alias("last"),
    )
    return by_account.groupBy("customer_id").agg(
        F.sum("n").alias("n"),
        F.sum("total_minor").alias("total_minor"),
        F.max("largest").alias("largest"),
        F.sum("suspicious").alias("suspicious"),
        F.sum("alerts").alias("alerts"),
        F.max("latest_alert").alias("latest_alert"),
        F.max("highest_alert").alias("highest_alert"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.array_sort(F.collect_list(F.struct(F.col("first.arrival_seq").alias("seq"), "account_id"))).alias("accounts"),
    )


def merge(deltas: DataFrame) -> DataFrame:
    """Fold the deltas of several batches, each transaction in one of them, to one row per customer."""
    firsts = deltas.select("customer_id", F.explode("accounts").alias("_a")).groupBy(
        "customer_id", F.col("_a.account_id").alias("account_id")
    ).agg(F.min("_a.seq").alias("seq"))
    accounts = firsts.groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "account_id"))).alias("accounts")
    )
    totals = deltas.groupBy("customer_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "total_minor")],
        F.max("largest").alias("largest"),
        *[F.sum(c).alias(c) for c in ("suspicious", "alerts")],
        *[F.max(c).alias(c) for c in ("latest_alert", "highest_alert")],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    return totals.join(accounts, "customer_id")


def snapshot(deltas: DataFrame) -> DataFrame:
    """Table view of a delta. Scores below the alert limit count only for the first transaction."""
    return deltas.select(
        "customer_id",
        F.transform("accounts", lambda a: a["account_id"]).alias("account_ids"),
        F.size("accounts").alias("account_count"),
        F.col("first.account_tier").alias("account_tier"),
        F.col("n").alias("total_transactions"),
        (F.col("total_minor") / 100.0).alias("total_amount"),
        (F.col("total_minor") / 100.0 / F.col("n")).alias("mean_amount"),
        F.col("largest").alias("max_amount"),
        F.col("suspicious").alias("suspicious_count"),
        F.col("alerts").alias("alert_count"),
        F.coalesce("latest_alert.risk_score", "first.risk_score").alias("latest_risk_score"),
        F.greatest("highest_alert", "first.risk_score").alias("highest_risk_score"),
        F.coalesce("latest_alert.risk_tier", "first.risk_tier").alias("latest_risk_tier"),
        F.col("first.event_ts").alias("first_seen"),
        F.col("last.event_ts").alias("last_seen"),
    )


def customer_snapshot(scored: DataFrame) -> DataFrame:
    return snapshot(delta(scored.where(F.coalesce("customer_id", F.lit("")) != "")))
