"""Behavioural features: 35 values per transaction from everything its customer did so far.

Two orders are offered. ``event_time`` takes the rows in (event time, arrival) order and is the fast
way for sorted input. ``arrival`` takes them in arrival order and is exact for any input: a row's
window is every earlier arrival whose event time is not older than the cutoff.

A customer with few rows is served by built-in windows on one shuffle. A customer with very many
rows is served by the segmented plan: see ``prefix`` and ``sliding``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from ..session import cut_lineage
from . import sliding
from .prefix import SEGMENT, Running, add_segments, broadcast_if_small, hot_keys, running

MAX_ROWS = 2_000_000
MAX_ROWS_PER_WEEK = 5_000
ROWS_PER_SEGMENT = 500_000

INPUT_COLUMNS = [
    "transaction_id", "account_id", "customer_id", "account_tier", "amount", "type", "channel",
    "is_suspicious", "suspicious_typology", "event_ts", "ts_us", "amount_minor", "arrival_seq",
]


def order_columns(order: str) -> list[str]:
    if order not in ("event_time", "arrival"):
        raise ValueError(f"unknown order {order!r}")
    return ["ts_us", "arrival_seq"] if order == "event_time" else ["arrival_seq"]


def split_by_size(
    txns: DataFrame, max_rows: int = MAX_ROWS, max_rows_per_week: int = MAX_ROWS_PER_WEEK
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary customers, and rows of hot customers if there are any."""
    hot = hot_keys(txns, "customer_id", "ts_us", max_rows, max_rows_per_week)
    if hot.isEmpty():
        return txns, None
    hot, _ = broadcast_if_small(cut_lineage(hot))
    # Rows without customer may be a hot group too, so nulls match.
    same = F.col("customer_id").eqNullSafe(F.col("_hot"))
    hot = hot.withColumnRenamed("customer_id", "_hot")
    return txns.join(hot, same, "left_anti"), txns.join(hot, same, "left_semi")


def std_from_sums(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from exact integer sums, the same way for every n.

    Squares are taken around the mean's integer part m: their sum q - 2mt + nm² is exact, and what is left of the
    mean is below one, so nothing large cancels in floating point and no product outgrows the decimals.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    floor = X.floor_div(total, n)
    rest = (total - floor * n).cast("double")
    around = (wide(squares) - wide(floor) * (total + (total - floor * n)).cast("decimal(20,0)")).cast("double")
    variance = (around - rest * rest / n) / n
    return F.sqrt(F.greatest(variance, F.lit(0.0))) / 100.0


def baseline(txns: DataFrame, order: str) -> DataFrame:
    """Running state of the customer after each row: totals, usual channel and hour, accounts, age."""
    position = order_columns(order)
    earlier_wins = [(-F.col(c)) for c in position]
    one = F.lit(1).cast("bigint")

    def add(df, keys, values, source=None):
        return running(df, keys, position, values, source=source)

    df = txns.withColumn("_hour", F.hour("event_ts"))
    if SEGMENT in df.columns:
        df = cut_lineage(df.repartition("customer_id", SEGMENT))
    else:
        df = df.repartition("customer_id")
    rows = df
    for value, prefix in (("channel", "_channel"), ("_hour", "_hours")):
        first_seen = [Running(f"{prefix}_first{i}", "first", c) for i, c in enumerate(earlier_wins)]
        df = add(df, ["customer_id", value], [Running(f"{prefix}_n", "sum", one), *first_seen], rows)
        rank = F.struct(
            F.col(f"{prefix}_n"), *[F.col(f.name) for f in first_seen], F.col(value).alias("value")
        )
        df = df.withColumn(f"{prefix}_rank", rank).drop(f"{prefix}_n", *[f.name for f in first_seen])
    df = add(df, ["customer_id", "account_id"], [Running("_account_n", "sum", one)], rows)

    # The most frequent value so far is the highest (count, first seen) any row has reached so far.
    amount = F.col("amount_minor")
    wide = amount.cast("decimal(19,0)")
    df = add(
        df,
        ["customer_id"],
        [
            Running("txns_so_far", "sum", one),
            Running("_total", "sum", amount),
            Running("_squares", "sum", wide * wide),
            Running("max_so_far_minor", "max", amount),
            Running("min_so_far_minor", "max", -amount),
            Running("_usual_channel", "max", F.col("_channel_rank")),
            Running("_usual_hour", "max", F.col("_hours_rank")),
            Running("accounts_per_customer", "sum", F.when(F.col("_account_n") == 1, one).otherwise(0)),
            Running("_first_us", "first", F.col("ts_us")),
            Running("_previous_us", "prev", F.col("ts_us")),
        ],
    )
    return df.withColumn("min_so_far_minor", -F.col("min_so_far_minor"))


def assemble(df: DataFrame, keep: list[str]) -> DataFrame:
    """Final feature columns from the baseline and window columns."""
    n = F.col("txns_so_far")
    mean = X.major_units("_total") / n
    constant = (n < 2) | (F.col("max_so_far_minor") == F.col("min_so_far_minor"))
    raw_std = F.when(constant, 0.0).otherwise(std_from_sums(n, F.col("_total"), F.col("_squares")))
    std = F.when(constant, 1.0).otherwise(raw_std)
    amount = F.col("amount")
    limit = float(S.REPORTING_THRESHOLD)
    n24 = F.col("n_24h")
    mean24 = X.major_units("s_24h") / n24
    std24 = F.coalesce("std_24h", std_from_sums(n24, F.col("s_24h"), F.col("q_24h")))
    computed = {
        "inter_txn_interval_seconds": F.coalesce((F.col("ts_us") - F.col("_previous_us")) / 1e6, F.lit(-1.0)),
        "daily_txn_count": n24,
        "hourly_txn_count": F.col("n_1h"),
        "daily_velocity": n24 / F.lit(24.0),
        "amount_vs_customer_mean": amount / F.greatest(mean, F.lit(1.0)),
        "amount_zscore": (amount - mean) / std,
        "channel_consistency": X.flag(F.col("channel") == F.col("_usual_channel.value")),
        "hour_consistency": X.flag(F.abs(F.col("_hour") - F.col("_usual_hour.value")) <= 2),
        "sum_1h": X.major_units("s_1h"),
        "sum_24h": X.major_units("s_24h"),
        "sum_7d": X.major_units("s_7d"),
        "count_1h": F.col("n_1h"),
        "count_24h": n24,
        "cross_account_sum_24h": X.major_units("s_24h"),
        "cross_account_threshold_ratio": X.major_units("s_24h") / limit,
        "cross_account_sum_6h": X.major_units("s_6h"),
        "cross_account_ratio_6h": X.major_units("s_6h") / limit,
        "max_single_24h": X.major_units("max_24h"),
        "cov_24h": F.when(n24 > 1, std24 / F.greatest(mean24, F.lit(1.0))).otherwise(0.0),
        "account_age_days": X.floor_div(F.col("ts_us") - F.col("_first_us"), S.DAY),
        "unique_counterparties_24h": F.col("accounts_24h"),
    }
    labels = {
        "is_suspicious": X.flag(F.col("is_suspicious")),
        "suspicious_typology": F.coalesce(F.nullif("suspicious_typology", F.lit("")), F.lit("normal")),
    }
    scalars = X.amount_features() + X.temporal_features() + X.encoding_features()
    state = {
        "mean_so_far": mean,
        "std_so_far": raw_std,
        "max_so_far": X.major_units("max_so_far_minor"),
        "min_so_far": X.major_units("min_so_far_minor"),
    }
    kept = ["n_60s", "round_24h", "txns_so_far", "account_tier", "type", "channel", "event_ts", "ts_us", "arrival_seq", *keep]
    # Two steps: the labels replace source columns of the same name.
    wide = df.select(
        *S.ID_COLUMNS, "amount", "accounts_per_customer", *kept, *scalars,
        *[c.alias(name) for name, c in {**computed, **labels, **state}.items()],
    )
    return wide.select(*S.FEATURE_COLUMNS, *S.LABEL_COLUMNS, *S.ID_COLUMNS, *state, *kept)


def features(
    txns: DataFrame,
    order: str = "event_time",
    max_rows: int = MAX_ROWS,
    max_rows_per_week: int = MAX_ROWS_PER_WEEK,
    rows_per_segment: int = ROWS_PER_SEGMENT,
    keep: list[str] | None = None,
) -> DataFrame:
    """35 model columns, 2 labels and 3 ids, plus the running state that rules and scoring use.
    ``keep`` names further input columns to carry along, such as model scores."""
    keep = keep or []
    rows = txns.select(*INPUT_COLUMNS, *keep)
    ordinary, hot = split_by_size(rows, max_rows, max_rows_per_week)
    state = baseline(ordinary, order)
    if order == "event_time":
        windows = sliding.ordinary(state)
    else:
        windows = sliding.by_arrival(state.withColumn("_place", F.col("txns_so_far")))
    result = assemble(windows, keep)
    if hot is None:
        return result

    position = order_columns(order)
    unit = S.MINUTE if order == "event_time" else max(rows_per_segment // 8, 1)
    segmented = add_segments(hot, ["customer_id"], position[0], unit, rows_per_segment)
    state = cut_lineage(baseline(segmented, order))
    if order == "event_time":
        busy = sliding.busy(state, rows_per_segment)
    else:
        busy = sliding.by_arrival(state.withColumn("_place", F.col("txns_so_far")), rows_per_segment)
    return result.unionByName(assemble(busy, keep))


def feature_matrix(txns: DataFrame, order: str = "event_time", **sizes) -> DataFrame:
    """The 40-column feature table."""
    wide = features(txns, order, **sizes)
    return wide.select(*S.FEATURE_COLUMNS, *S.LABEL_COLUMNS, *S.ID_COLUMNS)
