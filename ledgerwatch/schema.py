"""Schemas and fixed values shared by every job."""

from pyspark.sql import types as T

# Canonical transaction message, 13 fields.
TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("account_tier", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("balance_after", T.DoubleType()),
        T.StructField("is_suspicious", T.BooleanType()),
        T.StructField("suspicious_typology", T.StringType()),
    ]
)

# Topic message: what a Kafka source delivers once the value is decoded.
ENVELOPE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("value", TRANSACTION),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

# Regulatory limits in naira.
REPORTING_THRESHOLD = 5_000_000
ATM_DAILY_MAX = 100_000
TIER_1_DAILY_MAX = 30_000
LATE_NIGHT_HOURS = (1, 4)
# Amounts beyond are no amounts: their square sums outgrow the decimals.
AMOUNT_MAX = 1e12

# Numeric encodings and what an unknown value becomes.
TIER_CODES = {"TIER_1": 1, "TIER_2": 2, "TIER_3": 3}
CHANNEL_CODES = {"ATM": 0, "mobile": 1, "POS": 2, "USSD": 3}
TYPE_CODES = {"withdrawal": 0, "transfer": 1, "bill_payment": 2, "airtime": 3}
UNKNOWN_TIER, UNKNOWN_CHANNEL, UNKNOWN_TYPE = 0, -1, -1

# What a missing field of a stored transaction becomes.
FIELD_DEFAULTS = {
    "account_id": "UNKNOWN",
    "customer_id": "UNKNOWN",
    "account_tier": "TIER_2",
    "amount": 0.0,
    "currency": "NGN",
    "type": "transfer",
    "channel": "mobile",
    "is_suspicious": False,
}

# Fusion weights, tier limits and the score from which an alert is stored.
FUSION_WEIGHTS = {"iso_score": "0.15", "rf_score": "0.40", "gnn_score": "0.45"}
HIGH_SCORE, MEDIUM_SCORE, ALERT_SCORE = 70, 40, 40

# The model's input columns, in the order models expect.
FEATURE_COLUMNS = [
    "amount", "amount_log", "threshold_proximity", "amount_roundness",
    "is_near_threshold", "exceeds_atm_daily", "exceeds_tier1_daily",
    "hour_of_day", "is_late_night", "is_weekend",
    "inter_txn_interval_seconds", "daily_txn_count", "hourly_txn_count",
    "daily_velocity", "amount_vs_customer_mean", "amount_zscore",
    "channel_consistency", "hour_consistency",
    "sum_1h", "sum_24h", "sum_7d", "count_1h", "count_24h",
    "cross_account_sum_24h", "cross_account_threshold_ratio",
    "cross_account_sum_6h", "cross_account_ratio_6h",
    "max_single_24h", "cov_24h",
    "accounts_per_customer", "account_age_days",
    "unique_counterparties_24h", "tier_numeric",
    "channel_numeric", "type_numeric",
]

ID_COLUMNS = ["transaction_id", "account_id", "customer_id"]
LABEL_COLUMNS = ["is_suspicious", "suspicious_typology"]

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR
WEEK = 7 * DAY
