"""Reading transactions: JSON Lines files, decoded topic messages, feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.scalars import micros, minor_units
from ..operators.prefix import broadcast_if_small


def event_time(text) -> Column:
    """Wall-clock time of an ISO-8601 text; an offset is dropped, not applied. Null if unreadable."""
    text = F.col(text) if isinstance(text, str) else text
    return text.try_cast("timestamp_ntz")


def with_event_time(df: DataFrame, on_bad_ts: str = "now") -> DataFrame:
    """``event_ts`` from ``timestamp``; unreadable times become now, or the row is dropped."""
    parsed = event_time("timestamp")
    if on_bad_ts == "now":
        return df.withColumn("event_ts", F.coalesce(parsed, F.localtimestamp()))
    if on_bad_ts == "drop":
        return df.withColumn("event_ts", parsed).where(F.col("event_ts").isNotNull())
    raise ValueError(f"unknown on_bad_ts {on_bad_ts!r}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place in the input as ``arrival_seq``: files by name, lines in file order.

    Only line counts per file block are gathered; no line is sorted or moved.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("_file", "_start")
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        .select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    blocks, _ = broadcast_if_small(blocks)
    return lines.join(blocks, ["_file", "_start"]).select(
        "value", (F.col("_base") + F.col("_id") - F.col("_first")).alias("arrival_seq")
    )


def decode(lines: DataFrame) -> DataFrame:
    """Parse ``value``; ``reason`` says why a line cannot be used, null for good lines."""
    corrupt = T.StructType([*S.TRANSACTION.fields, T.StructField("_corrupt", T.StringType())])
    blank = F.trim("value") == ""
    # As a generator's output the struct is parsed once, however many fields and filters use it.
    once = F.array(F.from_json("value", corrupt, {"columnNameOfCorruptRecord": "_corrupt"}))
    parsed = lines.where(~blank).select("*", F.explode(once).alias("_txn"))
    amount = F.col("_txn.amount")
    # NaN counts as larger than any number; beyond the limit, kobo don't fit.
    reason = (
        F.when(F.col("_txn._corrupt").isNotNull(), "malformed")
        .when(F.coalesce(F.col("_txn.customer_id"), F.lit("")) == "", "no_customer")
        .when(F.coalesce(F.abs(amount) > S.AMOUNT_MAX, F.lit(False)), "bad_amount")
    )
    return parsed.withColumn("reason", reason)


def valid_transactions(lines: DataFrame, on_bad_ts: str = "now") -> DataFrame:
    """Usable transactions of raw lines, with event time and integer amount."""
    kept = [c for c in lines.columns if c != "value"]
    txns = decode(lines).where(F.col("reason").isNull()).select(*kept, *[f"_txn.{f.name}" for f in S.TRANSACTION])
    return complete(with_event_time(txns, on_bad_ts))


def routed(lines: DataFrame, on_bad_ts: str = "now") -> DataFrame:
    """Every line that isn't blank, once: ``status`` is accepted or rejected. Accepted ones carry their fields, event time and integer
    amount; rejected ones ``value`` and ``reason``. With ``on_bad_ts="drop"``, unreadable times are a reason too."""
    parsed = decode(lines)
    when = event_time(F.col("_txn.timestamp"))
    reason = F.col("reason") if on_bad_ts == "now" else F.coalesce("reason", F.when(when.isNull(), "bad_time"))
    rows = parsed.withColumn("reason", reason)
    good = F.col("reason").isNull()
    kept = [c for c in lines.columns if c != "value"]
    fields = [F.when(good, F.col(f"_txn.{f.name}")).alias(f.name) for f in S.TRANSACTION]
    wide = rows.select(F.when(good, "accepted").otherwise("rejected").alias("status"), F.when(~good, F.col("value")).alias("value"), "reason", *kept, *fields)
    event = F.when(F.col("status") == "accepted", F.coalesce(event_time("timestamp"), F.localtimestamp()))
    return complete(wide.withColumn("event_ts", event))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines for the quarantine sink."""
    return decode(lines).where(F.col("reason").isNotNull()).select("value", "reason")


def complete(txns: DataFrame) -> DataFrame:
    return txns.withColumn("ts_us", micros("event_ts")).withColumn("amount_minor", minor_units("amount"))


def read_jsonl(spark: SparkSession, path: str, on_bad_ts: str = "now") -> DataFrame:
    return valid_transactions(read_lines(spark, path), on_bad_ts)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Feature table written by ``sinks.write_features``; the CSV schema is stated, not inferred."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    columns = [T.StructField(c, T.DoubleType()) for c in S.FEATURE_COLUMNS]
    columns += [T.StructField("is_suspicious", T.IntegerType()), T.StructField("suspicious_typology", T.StringType())]
    columns += [T.StructField(c, T.StringType()) for c in S.ID_COLUMNS]
    return spark.read.schema(T.StructType(columns)).option("header", True).csv(path)


# Topics ---------------------------------------------------------------------------------------


def envelope(txns: DataFrame, topic: Column, offset: Column, published_at: Column) -> DataFrame:
    """Messages as a Kafka sink takes them: ``topic``, ``key``, ``value`` (JSON)."""
    fields = [F.col(f.name) for f in S.TRANSACTION]
    message = F.struct(
        topic.alias("topic"), F.struct(*fields).alias("value"), offset.alias("offset"), published_at.alias("timestamp")
    )
    return txns.select(topic.alias("topic"), F.col("customer_id").alias("key"), F.to_json(message).alias("value"))


def open_envelope(messages: DataFrame) -> DataFrame:
    """``topic``, ``offset`` and the transaction of JSON messages; broken messages are skipped."""
    message = F.array(F.from_json("value", S.ENVELOPE))
    return (
        messages.select(F.explode(message).alias("_m"))
        .where(F.col("_m.topic").isNotNull())
        .select("_m.topic", F.coalesce("_m.offset", F.lit(0)).alias("offset"), F.col("_m.value").alias("value"))
    )


def unread(messages: DataFrame, offsets: DataFrame, max_records: int | None = None) -> DataFrame:
    """Messages of the subscribed topics not consumed yet. ``offsets``: topic, consumed."""
    positions = F.broadcast(offsets.select("topic", "consumed"))  # one row per subscribed topic
    fresh = messages.join(positions, "topic").where(F.col("offset") >= F.col("consumed")).drop("consumed")
    return fresh if max_records is None else fresh.orderBy("offset", "topic").limit(max_records)


def backlog(messages: DataFrame, offsets: DataFrame) -> DataFrame:
    """Per topic: messages in all, and those written but not consumed."""
    counts = messages.groupBy("topic").agg(F.count("*").alias("total"))
    pending = F.greatest(F.lit(0), F.coalesce("written", F.lit(0)) - F.coalesce("consumed", F.lit(0)))
    return counts.join(offsets, "topic", "left").select("topic", "total", pending.cast("bigint").alias("pending"))


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", max_records: int | None = None):
    """Kafka stream; the group's offsets live in the query's checkpoint."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_records:
        reader = reader.option("maxOffsetsPerTrigger", max_records)
    # Offsets repeat over partitions; with the partition behind them they order rows without ties.
    position = F.shiftleft(F.col("offset"), 16).bitwiseOR(F.col("partition").cast("bigint"))
    return reader.load().select(F.col("value").cast("string").alias("value"), position.alias("arrival_seq"))
