"""Column functions: everything here stays inside whole-stage codegen."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def micros(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * F.lit(S.DAY)
        + F.hour(ts).cast("bigint") * F.lit(S.HOUR)
        + F.minute(ts).cast("bigint") * F.lit(S.MINUTE)
        + (F.extract(F.lit("SECOND"), ts) * F.lit(S.SECOND)).cast("bigint")
    )


def floor_div(value, by: int) -> Column:
    """Integer floor division, exact for every bigint."""
    value = F.col(value) if isinstance(value, str) else value
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def from_micros(us) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    days = floor_div(us, S.DAY).cast("int")
    seconds = (F.pmod(us, F.lit(S.DAY)).cast("decimal(18,6)") / F.lit(S.SECOND)).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds)


def minor_units(amount) -> Column:
    """Amount in kobo: integer sums are exact in any order of addition."""
    return F.round(F.col(amount) * 100).cast("bigint")


def major_units(minor) -> Column:
    return (F.col(minor) if isinstance(minor, str) else minor) / F.lit(100.0)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def encode(column: str, codes: dict[str, int], unknown: int) -> Column:
    result = F.lit(unknown)
    for value, code in codes.items():
        result = F.when(F.col(column) == value, F.lit(code)).otherwise(result)
    return result


def tier_code() -> Column:
    return encode("account_tier", S.TIER_CODES, S.UNKNOWN_TIER)


def channel_code() -> Column:
    return encode("channel", S.CHANNEL_CODES, S.UNKNOWN_CHANNEL)


def type_code() -> Column:
    return encode("type", S.TYPE_CODES, S.UNKNOWN_TYPE)


def roundness() -> Column:
    """Closeness to a multiple of 100; ties go to the even hundred."""
    nearest = F.bround(F.col("amount") / 100) * 100
    return 1 - F.abs(F.col("amount") - nearest) / F.greatest(F.col("amount"), F.lit(1.0))


def is_round_amount() -> Column:
    """Whole naira part divisible by 10,000 (zero counts)."""
    return F.col("amount").cast("bigint") % 10000 == 0


def is_late_night(hour: Column) -> Column:
    return hour.between(*S.LATE_NIGHT_HOURS)


def finite_or(value, default: float) -> Column:
    """Replace null, NaN and infinities."""
    value = F.col(value) if isinstance(value, str) else value
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(value.isNull() | bad, F.lit(default)).otherwise(value)


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def risk_tier(score) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return (
        F.when(score >= S.HIGH_SCORE, "HIGH").when(score >= S.MEDIUM_SCORE, "MEDIUM").otherwise("LOW")
    )


def naira(amount, width: int = 0) -> Column:
    """``₦1,234.50``, optionally right-aligned inside ``width`` characters."""
    text = F.format_number(amount, 2)
    return F.concat(F.lit("₦"), F.lpad(text, width, " ") if width else text)


def amount_features() -> list[Column]:
    amount = F.col("amount")
    limit = float(S.REPORTING_THRESHOLD)
    return [
        F.log1p(amount).alias("amount_log"),
        (amount / limit).alias("threshold_proximity"),
        roundness().alias("amount_roundness"),
        flag((amount >= 0.9 * limit) & (amount < limit)).alias("is_near_threshold"),
        flag((amount > S.ATM_DAILY_MAX) & (F.col("channel") == "ATM")).alias("exceeds_atm_daily"),
        flag((amount > S.TIER_1_DAILY_MAX) & (F.col("account_tier") == "TIER_1")).alias("exceeds_tier1_daily"),
    ]


def temporal_features() -> list[Column]:
    hour = F.hour("event_ts")
    return [
        hour.alias("hour_of_day"),
        flag(is_late_night(hour)).alias("is_late_night"),
        flag(F.weekday("event_ts") >= 5).alias("is_weekend"),
    ]


def encoding_features() -> list[Column]:
    return [
        tier_code().alias("tier_numeric"),
        channel_code().alias("channel_numeric"),
        type_code().alias("type_numeric"),
    ]
