"""Window rules: tumbling windows per account and tier, with switchable profiles.

``rule`` runs one rule as filter, aggregate, having. ``flagged`` runs a whole profile in one scan
and one shuffle: each row is sent once per window length that has a rule interested in it, and one
aggregate holds the conditional sums of all rules of that length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X

KEYS = ["account_id", "account_tier"]
OUTPUT = [*KEYS, "flagged_amount", "txn_count", "rule_triggered", "severity", "detected_at"]


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    where: Callable[[], Column]
    window: int | None = None  # microseconds; none for a rule on single rows
    sum_above: float | None = None
    count_from: int | None = None
    mean_below: float | None = None

    def having(self, total_minor: Column, rows: Column) -> Column:
        tests = [rows > 0]
        if self.sum_above is not None:
            tests.append(total_minor > round(self.sum_above * 100))
        if self.count_from is not None:
            tests.append(rows >= self.count_from)
        if self.mean_below is not None:
            tests.append(total_minor < F.lit(round(self.mean_below * 100)) * rows)
        result = tests[0]
        for test in tests[1:]:
            result = result & test
        return result


def _type(*kinds: str) -> Column:
    return F.col("type").isin(*kinds)


def _atm_withdrawal() -> Column:
    return (F.col("channel") == "ATM") & _type("withdrawal")


def _always() -> Column:
    return F.lit(True)


# Rule names, severities, windows and limits of the production profile.
PRODUCTION = [
    Rule("DAILY_ATM_BREACH", "HIGH", _atm_withdrawal, S.DAY, sum_above=100_000),
    Rule("WEEKLY_WITHDRAWAL_BREACH", "HIGH", lambda: _type("withdrawal"), S.WEEK, sum_above=500_000),
    Rule("BURST_PATTERN", "HIGH", _always, S.MINUTE, count_from=3),
    Rule("STRUCTURING_DETECTED", "HIGH", lambda: _atm_withdrawal() & F.col("amount").between(90_000, 99_999), S.DAY, count_from=3),
    Rule("NFIU_THRESHOLD_APPROACH", "HIGH", lambda: _type("transfer", "withdrawal"), S.DAY, sum_above=4_500_000),
    Rule("LATE_NIGHT_HIGH_VALUE", "MEDIUM", lambda: _type("withdrawal") & (F.col("amount") > 50_000) & X.is_late_night(F.hour("event_ts"))),
    Rule("TRANSFER_VELOCITY", "MEDIUM", lambda: _type("transfer"), S.HOUR, count_from=5, mean_below=100_000),
    Rule("KYC_TIER1_BREACH", "HIGH", lambda: F.col("account_tier") == "TIER_1", S.DAY, sum_above=30_000),
    Rule("ROUND_AMOUNT_PATTERN", "MEDIUM", lambda: _type("transfer") & X.is_round_amount(), S.DAY, count_from=3),
]


def _changed(changes: dict[str, dict]) -> list[Rule]:
    return [replace(r, **changes.get(r.name, {})) for r in PRODUCTION]


# The demonstration profile compresses windows and lowers limits.
TEST = _changed(
    {
        "DAILY_ATM_BREACH": dict(window=2 * S.MINUTE, sum_above=1_000),
        "WEEKLY_WITHDRAWAL_BREACH": dict(window=2 * S.MINUTE, sum_above=2_000),
        "STRUCTURING_DETECTED": dict(where=lambda: _atm_withdrawal() & F.col("amount").between(900, 99_999), window=2 * S.MINUTE, count_from=2),
        "NFIU_THRESHOLD_APPROACH": dict(window=2 * S.MINUTE, sum_above=5_000),
        "LATE_NIGHT_HIGH_VALUE": dict(where=lambda: _type("withdrawal") & (F.col("amount") > 500)),
        "TRANSFER_VELOCITY": dict(window=2 * S.MINUTE, count_from=2),
        "KYC_TIER1_BREACH": dict(window=2 * S.MINUTE, sum_above=500),
        "ROUND_AMOUNT_PATTERN": dict(window=2 * S.MINUTE, count_from=2),
    }
)

# Wider windows for sparse data, where the production profile seldom fires.
WIDE = _changed(
    {
        "BURST_PATTERN": dict(window=6 * S.HOUR),
        "STRUCTURING_DETECTED": dict(window=S.WEEK, count_from=2),
        "TRANSFER_VELOCITY": dict(window=S.DAY, count_from=3),
        "ROUND_AMOUNT_PATTERN": dict(window=S.WEEK, count_from=2),
    }
)

PROFILES = {"production": PRODUCTION, "test": TEST, "wide": WIDE}


def find(profile: list[Rule], name: str) -> Rule:
    return next(r for r in profile if r.name == name)


def _labels(rule: Rule) -> list[Column]:
    return [F.lit(rule.name).alias("rule_triggered"), F.lit(rule.severity).alias("severity")]


def single_rows(txns: DataFrame, rule: Rule) -> DataFrame:
    """A rule without a window flags each matching row by itself."""
    return txns.where(rule.where()).select(
        *KEYS,
        F.col("amount").alias("flagged_amount"),
        F.lit(1).cast("bigint").alias("txn_count"),
        *_labels(rule),
        F.col("event_ts").alias("detected_at"),
    )


def rule(txns: DataFrame, which: Rule, offset: int = 0, closed: str = "left") -> DataFrame:
    """One rule. Buckets start at multiples of the window since 1970, shifted by ``offset``;
    ``closed="right"`` gives a row on a bucket edge to the earlier bucket."""
    if which.window is None:
        return single_rows(txns, which)
    end = bucket_end(F.col("ts_us"), which.window, offset, closed)
    return (
        txns.where(which.where())
        .groupBy(*KEYS, end.alias("_end"))
        .agg(F.sum("amount_minor").alias("_total"), F.count("*").alias("txn_count"))
        .where(which.having(F.col("_total"), F.col("txn_count")))
        .select(
            *KEYS, X.major_units("_total").alias("flagged_amount"), "txn_count", *_labels(which),
            X.from_micros("_end").alias("detected_at"),
        )
    )


def bucket_end(us: Column, width: int, offset: int = 0, closed: str = "left") -> Column:
    shifted = us - offset - (1 if closed == "right" else 0)
    return shifted - F.pmod(shifted, F.lit(width)) + (width + offset)


MATCHED = "_matched"


def with_matches(txns: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add a bit mask of the rules a row is of interest to: every predicate is evaluated once."""
    mask = F.lit(0)
    for i, r in enumerate(rules):
        mask = mask + F.when(r.where(), F.lit(1 << i)).otherwise(0)
    return txns.withColumn(MATCHED, mask)


def matches(bits: int) -> Column:
    return F.col(MATCHED).bitwiseAND(F.lit(bits)) != 0


def conditional_aggregates(rules: list[Rule]) -> list[Column]:
    """Sum and count of the rows each rule is interested in, side by side."""
    columns = []
    for i in range(len(rules)):
        columns.append(F.sum(F.when(matches(1 << i), F.col("amount_minor"))).alias(f"_total{i}"))
        columns.append(F.count(F.when(matches(1 << i), 1)).alias(f"_rows{i}"))
    return columns


def flag_array(rules: list[Rule], extra: Column | None = None) -> Column:
    """The flags of all rules that hold on an aggregated row."""
    outcomes = []
    for i, r in enumerate(rules):
        total, rows = F.coalesce(F.col(f"_total{i}"), F.lit(0)), F.col(f"_rows{i}")
        holds = r.having(total, rows)
        if extra is not None:
            holds = holds & (extra == F.lit(r.window))
        outcomes.append(
            F.when(
                holds,
                F.struct(X.major_units(total).alias("flagged_amount"), rows.alias("txn_count"), *_labels(r)),
            )
        )
    return F.array_compact(F.array(*outcomes))


def flags_of(aggregated: DataFrame, rules: list[Rule], detected_at: Column, extra: Column | None = None) -> DataFrame:
    """One output row per rule that holds on an aggregated row."""
    return (
        aggregated.select(*KEYS, detected_at.alias("detected_at"), F.explode(flag_array(rules, extra)).alias("_flag"))
        .select(*KEYS, "_flag.*", "detected_at")
        .select(*OUTPUT)
    )


def to_windows(txns: DataFrame, profile: list[Rule], offset: int = 0, closed: str = "left") -> DataFrame:
    """Each row once for every window length that has an interested rule: ``_to`` has the length, the window's end, and the row itself
    (length 0) for a rule without a window."""
    bits_of = lambda chosen: sum(1 << i for i, r in enumerate(profile) if chosen(r))
    bucket = lambda width, end, row: F.struct(
        F.lit(width).cast("bigint").alias("width"), end.alias("end"), row.alias("row")
    )
    nobody = F.lit(None).cast("bigint")
    targets = [
        F.when(
            matches(bits_of(lambda r: r.window == width)),
            bucket(width, bucket_end(F.col("ts_us"), width, offset, closed), nobody),
        )
        for width in sorted({r.window for r in profile if r.window is not None})
    ]
    # Rules on single rows travel along under their arrival number, each row its own group.
    single = bits_of(lambda r: r.window is None)
    if single:
        targets.append(F.when(matches(single), bucket(0, F.col("ts_us"), F.col("arrival_seq"))))
    return with_matches(txns, profile).select(*KEYS, "amount_minor", MATCHED, F.explode(F.array_compact(F.array(*targets))).alias("_to"))


def flagged(txns: DataFrame, profile: list[Rule], offset: int = 0, closed: str = "left") -> DataFrame:
    """All rules of a profile: one scan, one shuffle."""
    grouped = (
        to_windows(txns, profile, offset, closed)
        .groupBy(*KEYS, "_to.width", "_to.end", "_to.row")
        .agg(*conditional_aggregates(profile))
    )
    as_row = [replace(r, window=0, count_from=1) if r.window is None else r for r in profile]
    return flags_of(grouped, as_row, X.from_micros("end"), F.col("width"))
