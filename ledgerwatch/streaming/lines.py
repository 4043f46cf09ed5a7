"""Raw lines of a stream, good ones apart from those that cannot be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ingest


def route_batches(lines: DataFrame, path: str, checkpoint: str, on_bad_ts: str = "now", **trigger) -> StreamingQuery:
    """One pass that writes every line of a batch (``value``, ``arrival_seq``) to ``path``: accepted transactions and rejected lines in
    folders of their own. The sink's log names the files of each batch once, so a repeated batch adds nothing, and one bad line costs no
    good one."""
    return (
        ingest.routed(lines, on_bad_ts).writeStream.format("parquet").partitionBy("status")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
    )


def accepted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("status = 'accepted'").drop("status", "value", "reason")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The quarantine: lines as they came, and why they are here."""
    return spark.read.parquet(path).where("status = 'rejected'").select("value", "reason", "arrival_seq")
