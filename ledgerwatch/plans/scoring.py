"""Per-transaction rules, score fusion and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from .registry import MODEL_ONLY, UNREGISTERED, registry


def rule_conditions() -> list[tuple[str, Column]]:
    """The nine rules in check order, over the columns that ``features`` delivers. They look at the
    customer's sliding windows, unlike the window rules of ``rules``, which look at accounts."""
    col = F.col
    limit = S.REPORTING_THRESHOLD
    withdrawal, transfer = col("type") == "withdrawal", col("type") == "transfer"
    # The limits of each rule.
    return [
        ("NFIU_THRESHOLD_APPROACH", col("sum_24h") > 0.90 * limit),
        ("DAILY_ATM_BREACH", (col("channel") == "ATM") & withdrawal & (col("amount") > S.ATM_DAILY_MAX)),
        ("BURST_PATTERN", col("n_60s") >= 5),
        ("STRUCTURING_DETECTED", (col("count_24h") >= 3) & (col("sum_24h") > 0.85 * limit) & (col("amount") < limit)),
        ("WEEKLY_WITHDRAWAL_BREACH", withdrawal & (col("sum_7d") > 500_000)),
        ("LATE_NIGHT_HIGH_VALUE", X.is_late_night(col("hour_of_day")) & withdrawal & (col("amount") > 50_000)),
        ("TRANSFER_VELOCITY", transfer & (col("count_1h") >= 5)),
        ("KYC_TIER1_BREACH", (col("account_tier") == "TIER_1") & (col("amount") > S.TIER_1_DAILY_MAX)),
        ("ROUND_AMOUNT_PATTERN", transfer & (col("round_24h") >= 3)),
    ]


def triggered_rules() -> Column:
    names = [F.when(condition, F.lit(name)) for name, condition in rule_conditions()]
    return F.array_compact(F.array(*names)).alias("triggered_rules")


def normalise_anomaly(raw) -> Column:
    """Isolation score to [0, 1]."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return X.clip01(raw / F.lit(1.5))


def fused_score() -> Column:
    """Weighted scores times 100, to one decimal. Decimal arithmetic makes the rounding exact."""
    total = None
    for column, weight in S.FUSION_WEIGHTS.items():
        part = F.col(column).cast("decimal(9,6)") * F.lit(weight).cast("decimal(3,2)")
        total = part if total is None else total + part
    return F.round(total * 100, 1).cast("double")


def fuse(scored: DataFrame) -> DataFrame:
    """``risk_score`` and, from the rounded score, ``risk_tier``."""
    return scored.withColumn("risk_score", fused_score()).withColumn("risk_tier", X.risk_tier("risk_score"))


def with_regulation(alerts: DataFrame) -> DataFrame:
    """Texts of the first triggered rule, looked up in the nine-row registry."""
    texts = F.broadcast(registry(alerts.sparkSession).drop("severity"))  # nine fixed rows
    first = F.try_element_at("triggered_rules", F.lit(1))
    joined = alerts.withColumn("rule", first).join(texts, "rule", "left")
    chosen = [
        F.coalesce(c, F.when(F.col("rule").isNull(), MODEL_ONLY[c]).otherwise(UNREGISTERED[c])).alias(c)
        for c in MODEL_ONLY
    ]
    return joined.select(*alerts.columns, *chosen)


ALERT_COLUMNS = [
    "transaction_id", "account_id", "customer_id", "account_tier", "amount", "timestamp",
    "iso_score", "rf_score", "gnn_score", "risk_score", "risk_tier", "triggered_rules",
    "regulatory_reference", "legal_consequence", "recommended_action",
]


def with_defaults(txns: DataFrame) -> DataFrame:
    """Missing fields take the values that stored rows and features assume."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in S.FIELD_DEFAULTS.items() if c in txns.columns}
    if "amount_minor" in txns.columns:
        filled["amount_minor"] = F.coalesce("amount_minor", F.lit(0).cast("bigint"))
    return txns.withColumns(filled)


REPORTED = ("reported_tier", "reported_customer")


def scoring_input(txns: DataFrame) -> DataFrame:
    """Rows as rules and models see them, defaults filled; what was reported stays beside, for alerts and snapshots."""
    return with_defaults(txns.withColumns({"reported_tier": F.col("account_tier"), "reported_customer": F.col("customer_id")}))


def score_rows(rows: DataFrame, beside: list[str] | None = None) -> DataFrame:
    """Alert records of rows that already carry rules and model scores: no shuffle. Columns ``beside`` stay as they are."""
    tier = "reported_tier" if "reported_tier" in rows.columns else "account_tier"
    known = F.when(F.col("transaction_id").isNull(), "UNKNOWN").otherwise(F.col("transaction_id"))
    filled = rows.withColumns(
        {
            "transaction_id": known,
            "account_id": F.coalesce("account_id", F.lit("UNKNOWN")),
            "customer_id": F.coalesce("customer_id", F.lit("UNKNOWN")),
            "account_tier": F.coalesce(tier, F.lit("UNKNOWN")),
            "timestamp": F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        }
    )
    fused = with_regulation(fuse(filled))
    rounded = {c: F.round(F.col(c).cast("double"), 4) for c in S.FUSION_WEIGHTS}
    extra = [c for c in ("event_ts", "arrival_seq", "is_suspicious", "reported_customer") if c in rows.columns] + (beside or [])
    return fused.withColumns(rounded).select(*ALERT_COLUMNS, *extra)


def stored_alerts(scored: DataFrame) -> DataFrame:
    """What the alert table receives: medium and high scores, open for review."""
    return scored.where(F.col("risk_score") >= S.ALERT_SCORE).withColumns(
        {"reviewed": F.lit(False), "mlro_decision": F.lit("PENDING")}
    )


def high_alerts(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("risk_score") >= S.ALERT_SCORE) & (F.col("risk_tier") == "HIGH"))


def counters(which: Column | None = None) -> list[Column]:
    """Counts of a run over the rows ``which``; they add up over batches."""
    which = F.lit(True) if which is None else which
    tier = F.col("risk_tier")
    return [
        F.count_if(which).alias("transactions"),
        F.count_if(which & tier.isin("HIGH", "MEDIUM")).alias("flagged"),
        F.count_if(which & (tier == "HIGH")).alias("high_alerts"),
        F.count_if(which & (tier == "MEDIUM")).alias("medium_alerts"),
        F.count_if(which & (F.col("risk_score") >= S.ALERT_SCORE)).alias("alerts"),
    ]


def summary(scored: DataFrame) -> DataFrame:
    """Run counters: transactions, flagged, share, tiers."""
    return with_share(scored.agg(*counters()))


def with_share(counts: DataFrame) -> DataFrame:
    """Counts of a run with the share of flagged transactions in percent."""
    share = F.round(100.0 * F.col("flagged") / F.greatest("transactions", F.lit(1)), 4).alias("flagged_pct")
    return counts.select("transactions", "flagged", share, "high_alerts", "medium_alerts", "alerts")
