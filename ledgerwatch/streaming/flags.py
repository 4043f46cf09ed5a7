"""Window rules on a stream."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..functions import scalars as X
from ..plans import rules as R
from ..sources.keyed import KeyedTable

WINDOW = (*R.KEYS, "width", "end", "row")


def flagged(stream: DataFrame, profile: list[R.Rule], delay: str = "1 hour") -> DataFrame:
    """All rules of a profile. Rules with the same window share one stateful aggregate; a window is
    reported once, when the watermark has passed its end. The rule on single rows keeps no state."""
    timed = stream.withColumn("_time", F.timestamp_micros("ts_us")).withWatermark("_time", delay)
    parts = [R.single_rows(stream, r) for r in profile if r.window is None]
    for width in sorted({r.window for r in profile if r.window is not None}):
        rules = [r for r in profile if r.window == width]
        grouped = (
            R.with_matches(timed, rules)
            .where(F.col(R.MATCHED) != 0)
            .groupBy(*R.KEYS, F.window("_time", f"{width // 1_000_000} seconds"))
            .agg(*R.conditional_aggregates(rules))
        )
        parts.append(R.flags_of(grouped, rules, X.from_micros(F.unix_micros("window.end"))))
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_flags(flags: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """One append sink for all rules; ``trigger`` as for ``DataStreamWriter.trigger``."""
    return (
        flags.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def windows(stream: DataFrame, profile: list[R.Rule], lateness: int = S.HOUR) -> DataFrame:
    """The windows that a batch changes, open ones too, with the flags that hold now: one stateful aggregate for all lengths.

    A window's state goes when the watermark, taken from the ends of windows, has passed its end; the longest window runs ahead of
    its rows by its whole length, so the delay is that and ``lateness``. Windows without flags appear only where an earlier flag
    may have ended: a mean may rise, and a sum may fall by a negative amount."""
    rules = [r for r in profile if r.window is not None]
    timed = (
        R.to_windows(stream, rules)
        .select(*R.KEYS, "amount_minor", R.MATCHED, "_to.width", F.timestamp_micros("_to.end").alias("_end"))
        .withWatermark("_end", f"{(max(r.window for r in rules) + lateness) // 1_000_000} seconds")
    )
    grouped = timed.groupBy(*R.KEYS, "width", "_end").agg(*R.conditional_aggregates(rules), F.min("amount_minor").alias("_least"))
    ended = F.col("_least") < 0
    for i, rule in enumerate(rules):
        if rule.mean_below is not None:
            ended = ended | (F.col(f"_rows{i}") >= (rule.count_from or 1))
    changed = grouped.withColumn("flags", R.flag_array(rules, F.col("width"))).where((F.size("flags") > 0) | ended)
    nobody = F.lit(None).cast("bigint")
    out = changed.select(*R.KEYS, "width", F.unix_micros("_end").alias("end"), nobody.alias("row"), "flags")
    single = [replace(r, window=0, count_from=1) for r in profile if r.window is None]
    if single:
        rows = R.to_windows(stream, [r for r in profile if r.window is None])
        each = rows.select(*R.KEYS, "_to.*", *[F.when(R.matches(1 << i), F.col("amount_minor")).alias(f"_total{i}") for i in range(len(single))],
                           *[R.matches(1 << i).cast("bigint").alias(f"_rows{i}") for i in range(len(single))])
        out = out.unionByName(each.select(*WINDOW, R.flag_array(single, F.col("width")).alias("flags")))
    return out


def flag_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, WINDOW)


def flag_batches(stream: DataFrame, profile: list[R.Rule], path: str, checkpoint: str, lateness: int = S.HOUR, **trigger) -> StreamingQuery:
    """Upserts the changed windows of every batch by account, tier, length and end: an open window is there from its first row on,
    and replaced when it changes."""

    def process(batch: DataFrame, batch_id: int) -> None:
        flag_table(batch.sparkSession, path).upsert(batch, batch_id)

    return (
        windows(stream, profile, lateness).writeStream.foreachBatch(process).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def current_flags(spark: SparkSession, path: str) -> DataFrame:
    """All flags as of the last committed batch."""
    rows = flag_table(spark, path).read().select(*R.KEYS, "end", F.explode("flags").alias("_flag"))
    return rows.select(*R.KEYS, "_flag.*", X.from_micros("end").alias("detected_at")).select(*R.OUTPUT)
