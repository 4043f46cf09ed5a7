"""Transactions derived from the generic ``events`` table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import micros, minor_units


def derive(events: DataFrame) -> DataFrame:
    """One transaction per event; works on batch and streaming input alike."""
    k = F.col("k")
    owner = F.expr("user_id div 3")
    amount = (
        F.when(k % 10 == 0, F.round(F.col("value") * 25000, 2))
        .when(k % 10 == 1, F.round(90000 + F.col("value") * 20, 2))
        .when(k % 10 == 2, 10000 * (1 + F.floor(F.col("value") / 50)).cast("double"))
        .otherwise(F.round(F.col("value") * 1000, 2))
    )
    kind = (
        F.when(F.col("event_type").isin("click", "error"), "transfer")
        .when(F.col("event_type").isin("view", "purchase"), "withdrawal")
        .when(k % 2 == 0, "airtime")
        .otherwise("bill_payment")
    )
    channels = F.array(*[F.lit(c) for c in ("ATM", "mobile", "POS", "USSD")])
    cities = F.array(*[F.lit(c) for c in ("Lagos", "Abuja", "Ibadan", "Port Harcourt", "Kano")])
    pick = lambda options, n: F.element_at(options, (F.col("event_id") % n + 1).cast("int"))
    suspicious = k.isin(0, 1, 10, 11, 20)
    typology = (
        F.when(k.isin(0, 20), "structuring")
        .when(k == 1, "cross_account_structuring")
        .when(k == 10, "burst")
        .when(k == 11, "late_night")
    )
    return (
        events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .select(
            F.concat(F.lit("TXN-"), F.col("event_id")).alias("transaction_id"),
            F.concat(F.lit("ACC-"), F.col("user_id")).alias("account_id"),
            F.concat(F.lit("CUST-"), owner).alias("customer_id"),
            F.when(owner % 5 <= 1, "TIER_1").when(owner % 5 <= 3, "TIER_2").otherwise("TIER_3").alias("account_tier"),
            amount.alias("amount"),
            F.lit("NGN").alias("currency"),
            kind.alias("type"),
            F.when(k % 10 == 1, "ATM").otherwise(pick(channels, 4)).alias("channel"),
            pick(cities, 5).alias("location"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            F.round(F.col("value") * 5000, 2).alias("balance_after"),
            suspicious.alias("is_suspicious"),
            typology.alias("suspicious_typology"),
            F.col("ts").alias("event_ts"),
            F.col("event_id").alias("arrival_seq"),
            (k / F.lit(100)).cast("decimal(6,4)").alias("iso_score"),
            ((F.col("event_id") % 1000) / F.lit(1000)).cast("decimal(6,4)").alias("rf_score"),
            (((F.col("user_id") * 37 + k) % 100) / F.lit(100)).cast("decimal(6,4)").alias("gnn_score"),
            k.alias("k"),
        )
        .withColumn("ts_us", micros("event_ts"))
        .withColumn("amount_minor", minor_units("amount"))
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark.read.parquet(f"{sf_dir}/events.parquet"))


def out_of_order(txns: DataFrame) -> DataFrame:
    """The same rows, each arriving up to 28 places late; earlier events first within a place."""
    late = F.col("k") % 5
    return txns.withColumn("arrival_seq", (F.col("arrival_seq") + 7 * late) * 5 + (4 - late))
