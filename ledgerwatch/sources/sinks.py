"""Stored tables: transactions, alerts, customer snapshots, features, case reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scoring import high_alerts, stored_alerts, with_defaults
from .keyed import KeyedTable


def transaction_rows(txns: DataFrame) -> DataFrame:
    """Rows of the transaction table: defaults filled, the last arrival of an id wins.

    Aggregation keeps one row per id and map task, so repeated ids do not pile up in a shuffle.
    """
    columns = [
        "account_id", "customer_id", "account_tier", "amount", "currency", F.col("type").alias("txn_type"), "channel",
        "location", "balance_after", F.col("event_ts").alias("txn_timestamp"), "is_suspicious", "suspicious_typology",
    ]
    return (
        with_defaults(txns)
        .groupBy("transaction_id")
        .agg(F.max_by(F.struct(*columns), "arrival_seq").alias("_row"))
        .select("transaction_id", "_row.*")
    )


STORED_COLUMNS = [
    "transaction_id", "account_id", "customer_id", "account_tier", "amount", "currency", "txn_type", "channel", "location", "balance_after",
    "txn_timestamp", "is_suspicious", "suspicious_typology", "ingested_at",
]


def transaction_table(spark: SparkSession, path: str, buckets: int = 32) -> KeyedTable:
    return KeyedTable(spark, path, ("transaction_id",), buckets)


def write_transactions(txns: DataFrame, path: str, batch: int | None = None) -> None:
    """Upsert by transaction_id: rows of the same id are replaced, all others stay, and a repeated run changes nothing but ``ingested_at``.

    A write adds to the buckets of its ids and reads no others; readers see it whole or not at all."""
    rows = transaction_rows(txns).withColumn("ingested_at", F.current_timestamp())
    transaction_table(txns.sparkSession, path).upsert(rows.select(*STORED_COLUMNS), batch)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return transaction_table(spark, path).read()


def write_alerts(scored: DataFrame, path: str) -> None:
    stored_alerts(scored).withColumn("scored_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_high_alerts(scored: DataFrame, path: str) -> None:
    high_alerts(scored).write.mode("append").parquet(path)


def write_features(matrix: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = matrix.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def publish(messages: DataFrame, servers: str, checkpoint: str | None = None):
    """Send ``topic``, ``key``, ``value`` rows to Kafka: a table at once, a stream as a query."""
    rows = messages.select("topic", "key", "value")
    if not messages.isStreaming:
        return rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    return (
        rows.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document per case, in a folder per customer. A customer's reports go to one task, else every task would add a file
    to every folder; a customer with very many of them is split."""
    reports.withColumn("investigated_at", F.current_timestamp()).hint("rebalance", "customer_id").write.mode("append").partitionBy("customer_id").json(path)


def read_reports(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored reports; ``schema`` is that of the reports that were written."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("investigated_at", T.TimestampType())])).json(path)
