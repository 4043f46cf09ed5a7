"""Every query by name, over the tables of one data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalars as X
from ..functions.text import recommendation, strip_reasoning
from ..operators import accounts as A
from ..operators import evidence as E
from ..operators import features as FT
from ..operators import graph as G
from ..operators import graph_model as GM
from ..operators import metrics as M
from ..operators import models as MD
from ..operators.scaling import Scaler
from ..operators.snapshots import customer_snapshot as snapshot_of
from ..session import cut_lineage, scratch_path
from ..sources import ingest as I
from ..sources import sinks
from ..sources.events import derive, out_of_order, transactions
from ..streaming import features as stream_jobs
from ..streaming import flags as stream_rules
from ..streaming import lines as line_jobs
from . import rules as R
from . import scoring as SC
from .registry import registry

STREAM_BATCHES = 24
SCORES = ["iso_score", "rf_score", "gnn_score"]
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals, so that results do not depend on addition order."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema
        ]
    )


def feature_table(spark, sf, order="event_time"):
    txns = transactions(spark, sf)
    return FT.features(out_of_order(txns) if order == "arrival" else txns, order)


def scored_table(spark, sf):
    txns = transactions(spark, sf)
    wide = FT.features(txns, keep=SCORES)
    return SC.score_rows(wide.select(
        "transaction_id", "account_id", "customer_id", "account_tier", "amount", "event_ts", "arrival_seq",
        "is_suspicious", *SCORES, SC.triggered_rules(),
    ))


def fused_table(spark, sf):
    """Scores and tiers only: no feature is needed."""
    return SC.fuse(transactions(spark, sf))


# Sources and sinks -----------------------------------------------------------------------------


def raw_lines(spark, sf):
    """JSON lines with some blank, cut, anonymous and badly timed ones among them."""
    e = F.col("arrival_seq")
    txns = transactions(spark, sf)
    fields = [f.name for f in S.TRANSACTION]
    changed = {
        "customer_id": F.when(e % 83 == 0, F.when(e % 2 == 0, F.lit(""))).otherwise(F.col("customer_id")),
        "timestamp": F.when(e % 71 == 0, F.lit("not a time")).otherwise(F.col("timestamp")),
    }
    line = F.to_json(F.struct(*[changed.get(f, F.col(f)).alias(f) for f in fields]))
    value = F.when(e % 97 == 0, F.lit("   ")).when(e % 89 == 0, F.substring(line, 1, 90)).otherwise(line)
    # A generator's output is computed once; readers filter on the text several times.
    return txns.select(F.explode(F.array(value)).alias("value"), "arrival_seq")


def ingest_valid_rows(spark, sf):
    return I.valid_transactions(raw_lines(spark, sf)).select("transaction_id", "customer_id", "amount", "channel", "is_suspicious")


def ingest_rejected(spark, sf):
    return I.rejected_lines(raw_lines(spark, sf)).groupBy("reason").agg(F.count("*").alias("lines"))


def parse_event_time(spark, sf):
    return I.valid_transactions(raw_lines(spark, sf), on_bad_ts="drop").select("transaction_id", "event_ts")


def messages(spark, sf):
    txns = transactions(spark, sf)
    topic = F.element_at(F.array(F.lit("transactions"), F.lit("alerts"), F.lit("audit")), (F.col("k") % 3 + 1))
    sent = I.envelope(txns, topic, F.col("arrival_seq"), F.col("timestamp"))
    return sent.select(F.explode(F.array("value")).alias("value"))


def offsets(opened):
    written = F.max("offset") + 1
    return opened.groupBy("topic").agg(written.alias("written"), F.floor(written * 0.4).alias("consumed"))


def publish_envelope(spark, sf):
    return I.open_envelope(messages(spark, sf)).select(
        "topic", "offset", "value.transaction_id", "value.customer_id", "value.amount"
    )


def topic_slice(spark, sf):
    opened = I.open_envelope(messages(spark, sf))
    wanted = offsets(opened).where(F.col("topic").isin("transactions", "alerts"))
    return I.unread(opened, wanted).select("topic", "offset", "value.transaction_id")


def topic_poll(spark, sf):
    opened = I.open_envelope(messages(spark, sf))
    return I.unread(opened, offsets(opened), max_records=100).select("topic", "offset", "value.transaction_id")


def topic_backlog(spark, sf):
    opened = I.open_envelope(messages(spark, sf))
    return I.backlog(opened, offsets(opened))


def transactions_upsert(spark, sf):
    e = F.col("arrival_seq")
    txns = transactions(spark, sf).withColumn("channel", F.when(e % 7 != 0, F.col("channel")))
    resent = txns.where(e % 4 == 0).withColumns({"amount": F.col("amount") + 1, "arrival_seq": e + 1_000_000_000})
    path = scratch_path(spark, "transactions")
    sinks.write_transactions(txns, path)
    sinks.write_transactions(resent, path)  # replaces a quarter of the rows
    return sinks.read_transactions(spark, path).select(
        "transaction_id", "account_id", "customer_id", "account_tier", "amount", "currency", "txn_type", "channel",
        "location", "balance_after", "txn_timestamp", "is_suspicious", "suspicious_typology",
    )


def alert_view(scored):
    return rounded(scored.withColumn("triggered_rules", F.array_join("triggered_rules", ",")))


def alerts_sink(spark, sf):
    return alert_view(SC.stored_alerts(scored_table(spark, sf))).drop("event_ts", "arrival_seq", "is_suspicious", "timestamp")


def high_alert_feed(spark, sf):
    return alert_view(SC.high_alerts(scored_table(spark, sf))).select(
        "transaction_id", "account_id", "customer_id", "risk_score", "amount", "triggered_rules"
    )


def features_sink(spark, sf):
    """The feature table written as CSV with a header, and read back."""
    path = scratch_path(spark, "features")
    sinks.write_features(FT.feature_matrix(transactions(spark, sf)), path, "csv")
    back = I.read_features(spark, path, "csv")
    return rounded(back)


# Scalars ---------------------------------------------------------------------------------------


def scalar_amount_features(spark, sf):
    return rounded(transactions(spark, sf).select("transaction_id", *X.amount_features()))


def scalar_temporal_features(spark, sf):
    return transactions(spark, sf).select("transaction_id", *X.temporal_features())


def categorical_encoding(spark, sf):
    e = F.col("arrival_seq")
    odd = transactions(spark, sf).withColumns({
        "channel": F.when(e % 11 == 0, "branch").otherwise(F.col("channel")),
        "type": F.when(e % 13 == 0, "loan").otherwise(F.col("type")),
        "account_tier": F.when(e % 17 == 0, F.lit(None)).otherwise(F.col("account_tier")),
    })
    return odd.select("transaction_id", *X.encoding_features())


def narratives(spark, sf):
    """Analyst texts built around every document."""
    which = F.col("doc_id") % 5
    text = (
        F.when(which == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>\n We should file STR, not dismiss. ")))
        .when(which == 1, F.concat(F.lit("<think>"), "text"))
        .when(which == 2, F.concat("text", F.lit(" Dismiss.")))
        .when(which == 3, F.concat(F.lit("<think>file str</think>"), "text", F.lit(" Enhanced monitoring<think>\n</think>")))
        .otherwise(F.col("text"))
    )
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.alias("text"))


def text_recommendation(spark, sf):
    answer = strip_reasoning("text")
    return narratives(spark, sf).select(
        "doc_id", F.length(answer).alias("answer_length"), F.md5(answer).alias("answer_md5"), recommendation(answer).alias("recommendation")
    )


def risk_tiering(spark, sf):
    return transactions(spark, sf).select(
        "transaction_id", X.risk_tier(F.round(F.col("rf_score") * 100, 1)).alias("risk_tier"),
        SC.normalise_anomaly(F.col("iso_score").cast("double") * 2).alias("iso_normalised"),
    ).transform(rounded)


# Window rules ----------------------------------------------------------------------------------


def window_rule(name: str, profile: str = "wide") -> Query:
    return lambda spark, sf: R.rule(transactions(spark, sf), R.find(R.PROFILES[profile], name))


def flagged(profile: str, **alignment) -> Query:
    return lambda spark, sf: R.flagged(transactions(spark, sf), R.PROFILES[profile], **alignment)


# Features --------------------------------------------------------------------------------------

FEATURE_GROUPS = {
    "features_amount": S.FEATURE_COLUMNS[0:7],
    "features_temporal": S.FEATURE_COLUMNS[7:14],
    "features_baseline": S.FEATURE_COLUMNS[14:18],
    "features_window": S.FEATURE_COLUMNS[18:29],
    "features_relational": S.FEATURE_COLUMNS[29:35],
}


def feature_group(columns: list[str]) -> Query:
    return lambda spark, sf: rounded(feature_table(spark, sf).select("transaction_id", *columns))


def features_full(spark, sf):
    return rounded(FT.feature_matrix(transactions(spark, sf)))


def features_arrival_order(spark, sf):
    return rounded(FT.feature_matrix(out_of_order(transactions(spark, sf)), "arrival"))


def txn_rules(spark, sf):
    return feature_table(spark, sf).select("transaction_id", F.array_join(SC.triggered_rules(), ",").alias("triggered_rules"))


def alerts_missing_fields(spark, sf):
    """Scores and rules of transactions that lack their tier, type, channel or customer: rules see the stored defaults, alerts say UNKNOWN.
    Rows without customer are one customer of very many rows."""
    e = F.col("arrival_seq")
    kept = {"account_tier": 5, "channel": 7, "type": 11, "customer_id": 13}
    txns = transactions(spark, sf).withColumns({c: F.when(e % n != 0, F.col(c)) for c, n in kept.items()})
    wide = FT.features(SC.scoring_input(txns), keep=[*SCORES, *SC.REPORTED])
    scored = SC.score_rows(wide.withColumn("triggered_rules", SC.triggered_rules()))
    return alert_view(scored).select(
        "transaction_id", "account_id", "customer_id", "account_tier", "risk_score", "risk_tier", "triggered_rules")


# Accounts, graph, reports ----------------------------------------------------------------------


def account_table(spark, sf):
    return A.account_features(feature_table(spark, sf))


def account_features(spark, sf):
    return rounded(account_table(spark, sf).drop("first_seq"))


def account_features_serving(spark, sf):
    return rounded(A.account_features_serving(feature_table(spark, sf)))


EDGE_COLUMNS = ["account_id", "customer_id", "tier_numeric", "max_cross_ratio_6h"]


def graph_nodes(spark, sf, coordinated=True, columns=None):
    """Account rows, stored once with the columns needed: group totals read them several times."""
    accounts = account_table(spark, sf)
    return G.members(cut_lineage(accounts.select(*columns) if columns else accounts), coordinated)


def edges_shared_customer(spark, sf):
    nodes = graph_nodes(spark, sf, coordinated=False, columns=EDGE_COLUMNS)
    return G.degrees(nodes).select("account_id", "customer_neighbours")


def edges_coordinated(spark, sf):
    return G.degrees(graph_nodes(spark, sf, columns=EDGE_COLUMNS)).select("account_id", "tier_neighbours")


def edges_full(spark, sf):
    return G.degrees(graph_nodes(spark, sf, columns=EDGE_COLUMNS)).select("account_id", "neighbours", "edges_out")


def graph_stats(spark, sf):
    return rounded(G.graph_stats(graph_nodes(spark, sf), A.ACCOUNT_COLUMNS))


NEIGHBOR_COLUMNS = A.ACCOUNT_COLUMNS


def neighbor_mean(spark, sf):
    nodes = graph_nodes(spark, sf).select("account_id", "customer_group", "tier_group", *NEIGHBOR_COLUMNS)
    return rounded(G.neighbor_mean(nodes, NEIGHBOR_COLUMNS).select("account_id", *[f"mean_{c}" for c in NEIGHBOR_COLUMNS]))


def accounts_per_customer(spark, sf):
    return A.accounts_per_customer(transactions(spark, sf))


def account_dimension(spark, sf):
    return A.account_dimension(out_of_order(transactions(spark, sf)))


def suspicious_accounts(spark, sf):
    return A.suspicious_accounts(transactions(spark, sf))


def structuring_report(spark, sf):
    return rounded(A.structuring_report(feature_table(spark, sf)).drop("arrival_seq"))


PROFILED = S.FEATURE_COLUMNS


def feature_profile(spark, sf):
    return rounded(A.feature_profile(feature_table(spark, sf), PROFILED), 4)


def label_distribution(spark, sf):
    return M.label_distribution(transactions(spark, sf).withColumn("is_suspicious", F.col("is_suspicious").cast("int")))


def labelled(spark, sf):
    return fused_table(spark, sf).select(
        F.col("is_suspicious").cast("int").alias("label"), (F.col("risk_score") >= 60).cast("int").alias("prediction"),
        "risk_score", "account_tier",
    )


def classification_metrics(spark, sf):
    return rounded(M.confusion(labelled(spark, sf), "label", "prediction"))


def classification_by_tier(spark, sf):
    return rounded(M.confusion(labelled(spark, sf), "label", "prediction", ["account_tier"]))


def average_precision(spark, sf):
    return rounded(M.average_precision(labelled(spark, sf), "label", "risk_score", resolution=1000))


def anomaly_threshold(spark, sf):
    """Percentile of the raw score at one minus the share of suspicious rows."""
    txns = transactions(spark, sf)
    contamination = txns.agg(F.avg(F.col("is_suspicious").cast("int"))).first()[0]
    scored = txns.select((F.col("amount") / 1e6).alias("score"))
    threshold = M.percentile(scored, "score", 1 - contamination)
    return rounded(scored.agg(
        F.lit(threshold).alias("threshold"), F.count_if(F.col("score") >= threshold).alias("flagged")
    ))


def temporal_split(spark, sf):
    return M.temporal_split(transactions(spark, sf)).select("transaction_id", "split")


def node_split(spark, sf):
    firsts = transactions(spark, sf).groupBy("account_id").agg(F.min("arrival_seq").alias("first_seq"))
    return M.node_split(firsts).select("account_id", "split")


def class_weights(spark, sf):
    return rounded(M.class_weight_table(transactions(spark, sf)))


# Scores and alerts -----------------------------------------------------------------------------


def rule_registry(spark, sf):
    """Registered texts with the number of transactions that trigger each rule."""
    hits = feature_table(spark, sf).select(F.explode(SC.triggered_rules()).alias("rule")).groupBy("rule").agg(F.count("*").alias("triggered"))
    known = registry(spark)
    return known.join(hits, "rule", "left").select(
        "rule", "severity", F.length("regulatory_reference").alias("reference_length"), F.coalesce("triggered", F.lit(0)).alias("triggered")
    )


def score_fusion(spark, sf):
    return fused_table(spark, sf).select("transaction_id", "risk_score", "risk_tier")


def alerts(spark, sf):
    return alert_view(scored_table(spark, sf)).drop("event_ts", "arrival_seq", "is_suspicious")


def alert_regulatory_lookup(spark, sf):
    return scored_table(spark, sf).select("transaction_id", "regulatory_reference", "legal_consequence", "recommended_action")


def alert_summary(spark, sf):
    return SC.summary(fused_table(spark, sf))


def top_alert(spark, sf):
    return E.top_alert(fused_table(spark, sf)).select("transaction_id", "account_id", "customer_id", "risk_score", "risk_tier")


def high_alert_candidates(spark, sf):
    """Candidates among the newest rows: the list is taken in the order given, here latest first."""
    newest_first = fused_table(spark, sf).withColumn("arrival_seq", -F.col("arrival_seq"))
    return E.high_alert_candidates(newest_first).select("transaction_id", "risk_score", "risk_tier")


def customer_snapshot(spark, sf):
    snap = snapshot_of(out_of_order(fused_table(spark, sf)))
    return rounded(snap.withColumn("account_ids", F.array_join("account_ids", ",")))


# Evidence --------------------------------------------------------------------------------------


def recent_history(spark, sf):
    return E.recent_history(transactions(spark, sf)).select("customer_id", "transaction_id", "place")


def history_summary(spark, sf):
    return rounded(E.history_summary(transactions(spark, sf)))


def account_breakdown(spark, sf):
    """The whole history of every account of the customer; each customer also lists an account without rows."""
    txns = transactions(spark, sf)
    unused = txns.select("customer_id", F.concat("customer_id", F.lit("-UNUSED")).alias("account_id"))
    listed = txns.select("customer_id", "account_id").union(unused).distinct()
    return rounded(E.account_breakdown(txns, listed))


def alert_history(spark, sf):
    fused = fused_table(spark, sf)
    return E.alert_history(fused, E.top_alert(fused)).select("customer_id", "transaction_id")


def case_report(spark, sf):
    return report_view(reports_of(spark, sf))


def report_files(spark, sf):
    """The reports as JSON files in a folder per customer, read back."""
    path = scratch_path(spark, "reports")
    reports = reports_of(spark, sf)
    sinks.write_reports(reports, path)
    return report_view(sinks.read_reports(spark, path, reports.schema))


def reports_of(spark, sf):
    """A report for every high alert; the narrative of an alert is a document."""
    scored = scored_table(spark, sf)
    high = cut_lineage(SC.high_alerts(scored))  # read several times
    docs = spark.read.parquet(f"{sf}/documents.parquet").agg(F.count("*")).first()[0]
    text = narratives(spark, sf).withColumn("_slot", F.col("doc_id") % docs)
    chosen = high.select("transaction_id", (F.col("arrival_seq") % docs).alias("_slot")).join(text, "_slot").select(
        "transaction_id", F.col("text").alias("risk_assessment"), F.lit("pattern").alias("pattern_analysis"),
        F.lit("cross").alias("cross_account_analysis"), F.lit("draft").alias("str_draft"),
    )
    return E.case_report(high, transactions(spark, sf), chosen)


def report_view(reports):
    return rounded(reports.select(
        "transaction_id", "customer_id", "account_id", "alert.risk_score", "alert.risk_tier",
        F.array_join("all_accounts", ",").alias("all_accounts"), F.length("history").alias("history_length"),
        "steps.pattern_analysis", "steps.cross_account_analysis", F.md5("steps.risk_assessment").alias("assessment_md5"),
        "str_draft", "final_recommendation", "mlro_decision",
    ))


# Models ----------------------------------------------------------------------------------------


def training_set(spark, sf):
    return MD.TrainingSet.build(feature_table(spark, sf))


def standard_scale(spark, sf):
    """All 35 columns, scaled by the first three quarters of the rows."""
    split = M.temporal_split(cut_lineage(feature_table(spark, sf)))
    scaler = Scaler.fit(split.where("split = 'train'"), S.FEATURE_COLUMNS)
    return rounded(split.select("transaction_id", *scaler.expressions()))


def scaler_reload(spark, sf):
    """The same by a scaler that was saved to the shared folder and read back."""
    split = M.temporal_split(cut_lineage(feature_table(spark, sf)))
    path = scratch_path(spark, "scaler")
    Scaler.fit(split.where("split = 'train'"), S.FEATURE_COLUMNS).save(spark, path)
    return rounded(split.select("transaction_id", *Scaler.load(spark, path).expressions()))


def smote_neighbors(spark, sf):
    found = MD.neighbour_table(training_set(spark, sf).train.where("label = 1"))
    return rounded(found.select(F.col("id").alias("transaction_id"), "place", "distance"))


def smote(spark, sf):
    balanced = MD.oversample(training_set(spark, sf))
    return rounded(balanced.select("id", "label", F.element_at("x", 1).alias("amount_scaled")))


def isolation_forest(spark, sf):
    data = training_set(spark, sf)
    return MD.anomaly_predictions(data, MD.fit_isolation_forest(data)).withColumnRenamed("id", "transaction_id")


def random_forest(spark, sf):
    data = training_set(spark, sf)
    model = MD.fit_random_forest(MD.oversample(data))
    return MD.forest_predictions(model, data.test).withColumnRenamed("id", "transaction_id")


def feature_importance(spark, sf):
    return MD.feature_importance(MD.fit_random_forest(MD.oversample(training_set(spark, sf))), spark)


def gnn_scores(spark, sf):
    return GM.graph_scores(account_table(spark, sf))


def sage_forward(spark, sf):
    return rounded(GM.sage_forward(GM.scaled_nodes(account_table(spark, sf)), GM.random_weights()))


def score_end_to_end(spark, sf):
    """Features, three trained models, fusion, rules and alert records."""
    wide = cut_lineage(feature_table(spark, sf))
    data = MD.TrainingSet.build(wide)
    forest = MD.fit_random_forest(MD.oversample(data))
    anomaly = MD.fit_isolation_forest(data)
    graph = GM.graph_scores(A.account_features(wide))
    ruled = MD.score_transactions(wide, data.scaler, anomaly, forest, graph).withColumn("triggered_rules", SC.triggered_rules())
    return alert_view(SC.score_rows(ruled)).drop("event_ts", "arrival_seq", "is_suspicious")


# Streams ---------------------------------------------------------------------------------------


def in_turn(spark, path):
    """Gives the files of a table rising times in the order of their names, so that a stream takes them in that order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for i, file in enumerate(files):
        fs.setTimes(file, 1_600_000_000_000 + 1000 * i, -1)


def arrival_stream(spark, sf, batches=STREAM_BATCHES):
    """The whole table as a stream of ``batches`` batches in arrival order."""
    path = scratch_path(spark, "arrivals")
    txns = transactions(spark, sf)
    txns.repartitionByRange(batches, "arrival_seq").write.parquet(path)
    in_turn(spark, path)
    return spark.readStream.schema(txns.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_flagged(spark, sf):
    """Window rules batch by batch: open windows appear, and are replaced as they grow."""
    path = scratch_path(spark, "flags")
    # Events come in order of their numbers, which is no order of time: rows may be late by any time here.
    stream_rules.flag_batches(arrival_stream(spark, sf, 4), R.PRODUCTION, f"{path}/table", f"{path}/checkpoint", lateness=1000 * S.DAY).awaitTermination()
    return stream_rules.current_flags(spark, f"{path}/table")


def stream_features(spark, sf):
    path = scratch_path(spark, "stream")
    job = stream_jobs.FeatureStream(path, lateness=None)
    stream_jobs.feature_batches(arrival_stream(spark, sf), job, f"{path}/checkpoint").awaitTermination()
    return rounded(stream_jobs.read_features(spark, path).select(*S.FEATURE_COLUMNS, *S.LABEL_COLUMNS, *S.ID_COLUMNS))


def consumed(spark, sf, batches=6):
    """The consumer end to end over a stream whose scores come with the rows: its folder and the counters of its run."""
    path = scratch_path(spark, "consumer")
    job = stream_jobs.FeatureStream(path, keep=tuple(SCORES), lateness=None)
    counters = stream_jobs.RunCounters()
    spark.streams.addListener(counters)
    try:
        query = stream_jobs.score_batches(arrival_stream(spark, sf, batches), job, lambda rows: rows, f"{path}/checkpoint")
        query.awaitTermination()
        counters.wait(query)
    finally:
        spark.streams.removeListener(counters)
    return path, counters


def stream_snapshot(spark, sf):
    path, _ = consumed(spark, sf)
    snap = stream_jobs.current_snapshots(spark, path)
    return rounded(snap.withColumn("account_ids", F.array_join("account_ids", ",")))


def stream_counters(spark, sf):
    """Counters observed while the batches were scored, without a pass of their own."""
    _, counters = consumed(spark, sf, 2)
    counts = {k: v for k, v in counters.totals().items() if k != "late"}
    return SC.with_share(spark.createDataFrame([counts], ", ".join(f"{k} bigint" for k in counts)))


def stream_rejected(spark, sf):
    """Raw lines through the stream's router: what becomes of every line, and the good rows of the batches that hold bad ones."""
    path = scratch_path(spark, "lines")
    lines = raw_lines(spark, sf)
    lines.repartitionByRange(6, "arrival_seq").write.parquet(f"{path}/in")
    in_turn(spark, f"{path}/in")
    source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    line_jobs.route_batches(source, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    good = line_jobs.accepted(spark, f"{path}/out").select("arrival_seq", F.lit("accepted").alias("status"), "transaction_id", "customer_id", "amount")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("transaction_id", "string"), ("customer_id", "string"), ("amount", "double"))]
    return good.unionByName(line_jobs.rejected(spark, f"{path}/out").select("arrival_seq", F.col("reason").alias("status"), *nothing))


RULE_KEYS = {
    "rule_daily_atm": "DAILY_ATM_BREACH",
    "rule_weekly_withdrawal": "WEEKLY_WITHDRAWAL_BREACH",
    "rule_burst": "BURST_PATTERN",
    "rule_structuring": "STRUCTURING_DETECTED",
    "rule_nfiu": "NFIU_THRESHOLD_APPROACH",
    "rule_late_night": "LATE_NIGHT_HIGH_VALUE",
    "rule_transfer_velocity": "TRANSFER_VELOCITY",
    "rule_kyc_tier1": "KYC_TIER1_BREACH",
    "rule_round_amount": "ROUND_AMOUNT_PATTERN",
}


def catalog() -> dict[str, Query]:
    here = globals()
    named = [
        "ingest_valid_rows", "ingest_rejected", "parse_event_time", "publish_envelope", "topic_slice", "topic_poll",
        "topic_backlog", "transactions_upsert", "alerts_sink", "high_alert_feed", "features_sink",
        "scalar_amount_features", "scalar_temporal_features", "categorical_encoding", "text_recommendation", "risk_tiering",
        "features_full", "features_arrival_order", "txn_rules", "alerts_missing_fields",
        "account_features", "account_features_serving", "edges_shared_customer", "edges_coordinated", "edges_full",
        "graph_stats", "neighbor_mean", "accounts_per_customer", "account_dimension", "suspicious_accounts",
        "structuring_report", "feature_profile", "label_distribution", "classification_metrics", "classification_by_tier",
        "average_precision", "anomaly_threshold", "temporal_split", "node_split", "class_weights",
        "rule_registry", "score_fusion", "alerts", "alert_regulatory_lookup", "alert_summary", "top_alert",
        "high_alert_candidates", "customer_snapshot",
        "recent_history", "history_summary", "account_breakdown", "alert_history", "case_report", "report_files",
        "standard_scale", "scaler_reload", "smote_neighbors", "smote", "isolation_forest", "random_forest", "feature_importance",
        "gnn_scores", "sage_forward", "score_end_to_end", "stream_flagged", "stream_features", "stream_snapshot",
        "stream_counters", "stream_rejected",
    ]
    queries: dict[str, Query] = {name: here[name] for name in named}
    queries.update({key: window_rule(name) for key, name in RULE_KEYS.items()})
    queries.update({key: feature_group(columns) for key, columns in FEATURE_GROUPS.items()})
    queries["flagged_transactions"] = flagged("production")
    queries["flagged_wide_profile"] = flagged("wide")
    queries["flagged_test_profile"] = flagged("test")
    # Weeks from Monday, edges belonging to the earlier bucket.
    queries["flagged_aligned"] = flagged("production", offset=4 * S.DAY, closed="right")
    return queries
