"""Features, scores, alerts and snapshots of a stream.

Features come from Spark's keyed state (see ``state``); models, rules and fusion are columns on top, so a stream of transactions becomes
a stream of scored rows in one plan. Sinks take it batch by batch, each under the batch's number, so a repeated batch replaces its
own output. Rows too late for the state go to a table of their own.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import schema as S
from ..operators import features as FT
from ..operators import snapshots
from ..plans import scoring
from ..sources import sinks
from ..sources.keyed import KeyedTable
from .state import with_state

COUNTERS = "run_counters"


@dataclass(frozen=True)
class FeatureStream:
    """``path`` holds the outputs; ``keep`` names extra input columns carried along. A row may be older than its customer's newest
    event by ``lateness`` microseconds; None: by any time, and nothing is ever removed from the state."""

    path: str
    keep: tuple[str, ...] = ()
    lateness: int | None = S.WEEK

    def features(self, stream: DataFrame) -> DataFrame:
        """Feature rows of a stream of transactions, with ``late``."""
        return FT.assemble(with_state(stream, [*FT.INPUT_COLUMNS, *self.keep], self.lateness), [*self.keep, "late"])


def feature_batches(stream: DataFrame, job: FeatureStream, checkpoint: str, **trigger) -> StreamingQuery:
    """Write features under ``job.path/features``, late rows apart: one pass, each row once."""
    return (
        job.features(stream).writeStream.format("parquet").partitionBy("late")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(f"{job.path}/features")
    )


def read_features(spark: SparkSession, path: str, late: bool = False) -> DataFrame:
    return spark.read.parquet(f"{path}/features").where(F.col("late") == F.lit(late)).drop("late")


# Columns of the transaction table that scoring changes or has no use for; they travel beside.
STORED = ("account_tier", "type", "channel", "currency", "location", "balance_after", "is_suspicious", "suspicious_typology")


def scored_stream(stream: DataFrame, job: FeatureStream, models: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scored rows of a stream, with what the transaction table needs, and counters of the run observed on the way.

    ``models`` adds iso_score, rf_score and gnn_score to feature rows."""
    rows = scoring.scoring_input(stream)
    kinds = {f.name: f.dataType for f in S.TRANSACTION.fields}
    beside = {f"stored_{c}": (F.col(c) if c in rows.columns else F.lit(S.FIELD_DEFAULTS.get(c))).cast(kinds[c]) for c in STORED}
    rows = rows.withColumns(beside | {"stored_customer": F.col("customer_id"), "stored_account": F.col("account_id"), "stored_id": F.col("transaction_id")})
    carried = ("stored_customer", "stored_account", "stored_id", *beside)
    wide = replace(job, keep=tuple(dict.fromkeys([*job.keep, *scoring.REPORTED, *carried]))).features(rows)
    ruled = models(wide).withColumn("triggered_rules", scoring.triggered_rules())
    scored = scoring.score_rows(ruled, [*carried, "late"]).withColumn("amount_minor", F.round(F.col("amount") * 100).cast("bigint"))
    return scored.observe(COUNTERS, *scoring.counters(~F.col("late")), F.count_if("late").alias("late"))


def score_batches(
    stream: DataFrame, job: FeatureStream, models: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger
) -> StreamingQuery:
    """The whole consumer: scores rows, upserts transactions, and writes alerts, the high-alert feed and customer snapshots."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = lambda name: f"{job.path}/{name}/batch={batch_id}"
        save = lambda df, name: df.write.mode("overwrite").parquet(out(name))
        save(batch, "scored")
        rows = spark.read.schema(batch.schema).parquet(out("scored"))
        scored = rows.where("NOT late").drop("late")
        save(rows.where("late"), "late")
        beside = [c for c in scored.columns if c.startswith("stored_")] + ["reported_customer"]
        alerts = scored.drop(*beside)
        save(scoring.stored_alerts(alerts), "alerts")
        save(scoring.high_alerts(alerts), "high_alerts")
        transactions = scored.select(
            F.col("stored_id").alias("transaction_id"), F.col("stored_account").alias("account_id"), F.col("stored_customer").alias("customer_id"),
            *[F.col(f"stored_{c}").alias(c) for c in STORED], "amount", "event_ts", "arrival_seq")
        sinks.write_transactions(transactions, f"{job.path}/transactions", batch_id)
        known = scored.where(F.coalesce("reported_customer", F.lit("")) != "")
        snapshot_table(spark, job.path).upsert(snapshots.delta(known.withColumn("is_suspicious", F.col("is_suspicious") == 1)), batch_id)

    return _start(scored_stream(stream, job, models), process, checkpoint, trigger)


def snapshot_table(spark: SparkSession, path: str) -> KeyedTable:
    """Mergeable rows per customer: a batch adds the deltas of its customers, which fold into one."""
    return KeyedTable(spark, f"{path}/snapshots", ("customer_id",), fold=snapshots.merge)


def current_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Customer snapshots as of the last committed batch."""
    return snapshots.snapshot(snapshot_table(spark, path).read())


class RunCounters(StreamingQueryListener):
    """Counters of a run, taken from the batches while they are computed; a repeated batch counts once."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(COUNTERS)
        if row is not None:
            with self.changed:
                self.batches[str(event.progress.id), event.progress.batchId] = row.asDict()
                self.changed.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.changed.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the last batch of an ended query is counted: listeners are told a little later."""
        last = query.lastProgress
        if last is not None:
            done = lambda: any(b >= last.batchId for q, b in self.batches if q == str(query.id))
            with self.changed:
                self.changed.wait_for(done, seconds)

    def totals(self) -> dict[str, int]:
        sums: dict[str, int] = {}
        for row in self.batches.values():
            for name, value in row.items():
                sums[name] = sums.get(name, 0) + (value or 0)
        return sums


def _start(stream: DataFrame, process, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
