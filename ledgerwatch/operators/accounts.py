"""Account-level features: 33 values per account, and per-account reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import finite_or

# Order of the account vector.
ACCOUNT_COLUMNS = [
    "log_mean_amount", "log_std_amount", "log_max_amount", "log_min_amount", "cov_amount",
    "max_threshold_proximity", "mean_threshold_proximity",
    "log_max_cross_sum_24h", "max_cross_ratio_24h", "log_max_cross_sum_6h", "max_cross_ratio_6h",
    "max_zscore", "max_vs_mean", "max_daily_count", "max_hourly_count", "max_daily_velocity",
    "late_night_rate", "weekend_rate", "mean_hour",
    "any_atm_breach", "any_tier1_breach", "any_near_threshold", "breach_rate",
    "tier_numeric", "accounts_per_customer", "log_txn_count",
    "mean_roundness", "max_roundness", "channel_consistency", "channel_numeric_mean", "type_numeric_mean",
    "log_max_sum_1h", "log_max_sum_24h",
]


def account_features(features: DataFrame) -> DataFrame:
    """One aggregate per account; every value merges on the map side, so a busy account is no
    bottleneck. Adds the customer and tier of the account's first arrival and the label."""
    seq = F.col("arrival_seq")
    mean = F.avg("amount")
    std = F.coalesce(F.stddev_pop("amount"), F.lit(0.0))
    peak, rate = F.max, F.avg
    values: dict[str, Column] = {
        "log_mean_amount": F.log1p(mean),
        "log_std_amount": F.log1p(std),
        "log_max_amount": F.log1p(peak("amount")),
        "log_min_amount": F.log1p(F.min("amount")),
        "cov_amount": std / F.greatest(mean, F.lit(1.0)),
        "max_threshold_proximity": peak("threshold_proximity"),
        "mean_threshold_proximity": rate("threshold_proximity"),
        "log_max_cross_sum_24h": F.log1p(peak("cross_account_sum_24h")),
        "max_cross_ratio_24h": peak("cross_account_threshold_ratio"),
        "log_max_cross_sum_6h": F.log1p(peak("cross_account_sum_6h")),
        "max_cross_ratio_6h": peak("cross_account_ratio_6h"),
        "max_zscore": peak("amount_zscore"),
        "max_vs_mean": peak("amount_vs_customer_mean"),
        "max_daily_count": peak("daily_txn_count"),
        "max_hourly_count": peak("hourly_txn_count"),
        "max_daily_velocity": peak("daily_velocity"),
        "late_night_rate": rate("is_late_night"),
        "weekend_rate": rate("is_weekend"),
        "mean_hour": rate("hour_of_day") / 24.0,
        "any_atm_breach": peak("exceeds_atm_daily"),
        "any_tier1_breach": peak("exceeds_tier1_daily"),
        "any_near_threshold": peak("is_near_threshold"),
        "breach_rate": rate("exceeds_atm_daily") + rate("exceeds_tier1_daily"),
        "tier_numeric": F.min_by("tier_numeric", seq),
        "accounts_per_customer": F.min_by("accounts_per_customer", seq),
        "log_txn_count": F.log1p(F.count("*")),
        "mean_roundness": rate("amount_roundness"),
        "max_roundness": peak("amount_roundness"),
        "channel_consistency": rate("channel_consistency"),
        "channel_numeric_mean": rate("channel_numeric"),
        "type_numeric_mean": rate("type_numeric"),
        "log_max_sum_1h": F.log1p(peak("sum_1h")),
        "log_max_sum_24h": F.log1p(peak("sum_24h")),
    }
    vector = [finite_or(values[c].cast("double"), 0.0).alias(c) for c in ACCOUNT_COLUMNS]
    return features.groupBy("account_id").agg(
        F.min_by("customer_id", seq).alias("customer_id"),
        F.min(seq).alias("first_seq"),
        *vector,
        F.max("is_suspicious").alias("label"),
    )


def account_features_serving(features: DataFrame) -> DataFrame:
    """The simplified vector used while scoring: the customer's state as of the account's last
    arrival, with fixed placeholders. Slot 23 is the number of accounts, where training has the tier."""
    limit = float(S.REPORTING_THRESHOLD)
    mean, std = F.col("mean_so_far"), F.col("std_so_far")
    high = F.col("max_so_far")
    sum_24h, sum_6h = F.col("sum_24h"), F.col("cross_account_sum_6h")
    ratio_24h = sum_24h / limit
    constant = lambda v: F.lit(v)
    values = {
        "log_mean_amount": F.log1p(mean),
        "log_std_amount": F.log1p(std),
        "log_max_amount": F.log1p(high),
        "log_min_amount": F.log1p("min_so_far"),
        "cov_amount": std / F.greatest(mean, F.lit(1.0)),
        "max_threshold_proximity": ratio_24h,
        "mean_threshold_proximity": ratio_24h,
        "log_max_cross_sum_24h": F.log1p(sum_24h),
        "max_cross_ratio_24h": ratio_24h,
        "log_max_cross_sum_6h": F.log1p(sum_6h),
        "max_cross_ratio_6h": sum_6h / limit,
        "max_zscore": (high - mean) / F.greatest(std, F.lit(1.0)),
        "max_vs_mean": high / F.greatest(mean, F.lit(1.0)),
        "max_daily_count": F.col("count_24h"),
        "max_hourly_count": F.col("count_1h"),
        "max_daily_velocity": F.col("count_24h") / F.lit(24.0),
        "mean_hour": F.col("hour_of_day") / F.lit(24.0),
        "tier_numeric": F.col("accounts_per_customer"),
        "accounts_per_customer": F.col("accounts_per_customer"),
        "log_txn_count": F.log1p("txns_so_far"),
        "log_max_sum_1h": F.log1p("sum_1h"),
        "log_max_sum_24h": F.log1p(sum_24h),
        # Placeholders of the serving vector.
        "late_night_rate": constant(0.0),
        "weekend_rate": constant(0.0),
        "any_atm_breach": constant(0.0),
        "any_tier1_breach": constant(0.0),
        "any_near_threshold": constant(0.0),
        "breach_rate": constant(0.0),
        "mean_roundness": constant(0.5),
        "max_roundness": constant(0.5),
        "channel_consistency": constant(0.5),
        "channel_numeric_mean": constant(1.5),
        "type_numeric_mean": constant(1.5),
    }
    state = ["mean_so_far", "std_so_far", "max_so_far", "min_so_far", "sum_1h", "sum_24h", "cross_account_sum_6h",
             "count_1h", "count_24h", "hour_of_day", "accounts_per_customer", "txns_so_far", "customer_id"]
    last = features.groupBy("account_id").agg(F.max_by(F.struct(*state), "arrival_seq").alias("_s"))
    vector = [finite_or(values[c].cast("double"), 0.0).alias(c) for c in ACCOUNT_COLUMNS]
    return last.select("account_id", "_s.*").select("account_id", "customer_id", *vector)


def account_dimension(txns: DataFrame) -> DataFrame:
    """Customer and tier of each account, from its first arrival."""
    return txns.groupBy("account_id").agg(
        F.min_by(F.struct("customer_id", "account_tier", F.col("transaction_id").alias("first_transaction")), "arrival_seq").alias("_r")
    ).select("account_id", "_r.*")


def accounts_per_customer(txns: DataFrame) -> DataFrame:
    """Number and list of a customer's accounts; distinct pairs are formed before the list."""
    pairs = txns.select("customer_id", "account_id").distinct()
    return pairs.groupBy("customer_id").agg(
        F.count("*").alias("accounts"), F.array_join(F.array_sort(F.collect_list("account_id")), ",").alias("account_ids")
    )


def suspicious_accounts(txns: DataFrame) -> DataFrame:
    return txns.groupBy("account_id").agg(F.max(F.col("is_suspicious").cast("int")).alias("label")).where("label = 1")


def structuring_report(features: DataFrame, single_rows: int = 5) -> DataFrame:
    """All cross-account structuring rows, and the first few of the single-account kind."""
    suspicious = features.where("is_suspicious = 1")
    typology = F.col("suspicious_typology")
    columns = ["account_id", "customer_id", "amount", "cross_account_sum_24h", "cross_account_threshold_ratio", "arrival_seq"]
    cross = suspicious.where(typology.contains("cross_account")).select(F.lit("cross_account").alias("kind"), *columns)
    single = (
        suspicious.where(typology.contains("structuring") & ~typology.contains("cross"))
        .orderBy("arrival_seq").limit(single_rows)
        .select(F.lit("single_account").alias("kind"), *columns)
    )
    return cross.unionByName(single)


def exact_mean(name: str, digits: int = 6) -> Column:
    """Mean of a column's values to ``digits`` decimals, rounded to as many: sums of decimals don't depend on the order of addition.
    Where a value isn't finite or is beyond the decimals, the plain mean."""
    value = F.col(name).cast("double")
    fits = F.abs(value) < 1e20
    total = F.sum(F.when(fits, F.round(value, digits).try_cast(f"decimal(28,{digits})")))
    return F.when(F.count_if(~fits) > 0, F.avg(value)).otherwise(F.round(total.cast("double") / F.count(value), digits))


def feature_profile(features: DataFrame, columns: list[str]) -> DataFrame:
    """Range, spread, missing values and distinct values of per-account means, one row per column."""
    means = features.groupBy("account_id").agg(*[exact_mean(c).alias(c) for c in columns])
    long = means.select(
        "account_id",
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])).alias("_f"),
    ).select("_f.*")
    infinite = F.col("value").isin(float("inf"), float("-inf"))
    # Distinct values by grouping, not by a set held in one task.
    values = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n")
    moments = long.groupBy("feature").agg(F.stddev_pop("value").alias("std"))
    counted = values.groupBy("feature").agg(
        F.sum(F.when(F.isnan(v), n).otherwise(0)).alias("nan_values"),
        F.sum(F.when(infinite, n).otherwise(0)).alias("inf_values"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count("*").alias("distinct_values"),
    )
    return counted.join(moments, "feature").withColumn("zero_variance", F.col("std") == 0)
