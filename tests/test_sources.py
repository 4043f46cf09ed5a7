import os

from pyspark.sql import functions as F

from ledgerwatch.functions.text import recommendation, strip_reasoning
from ledgerwatch.sources import ingest as I
from ledgerwatch.sources import sinks

GOOD = '{"transaction_id": "T%d", "account_id": "A", "customer_id": "C", "amount": 5.5, "timestamp": "%s"}'


def test_jsonl(spark, folder):
    lines = [
        GOOD % (1, "2026-07-04T19:01:05.749530Z"), "", "   ", '{"transaction_id": "T2", "customer_id": "C"', "not json",
        '{"transaction_id": "T3", "account_id": "A"}', '{"transaction_id": "T4", "customer_id": ""}',
        GOOD % (5, "2026-07-04T19:01:05+01:00"), GOOD % (6, "yesterday"),
    ]
    for name, part in (("a.jsonl", lines[:5]), ("b.jsonl", lines[5:])):
        with open(os.path.join(folder, name), "w") as f:
            f.write("\n".join(part) + "\n")
    rows = {r["transaction_id"]: r for r in I.read_jsonl(spark, folder, on_bad_ts="drop").collect()}
    assert sorted(rows) == ["T1", "T5"]
    assert str(rows["T1"]["event_ts"]) == "2026-07-04 19:01:05.749530" and str(rows["T5"]["event_ts"]) == "2026-07-04 19:01:05"
    assert (rows["T1"]["arrival_seq"], rows["T5"]["arrival_seq"]) == (0, 7)
    assert I.read_jsonl(spark, folder).count() == 3  # an unreadable time becomes now
    reasons = {r["reason"]: r["n"] for r in I.rejected_lines(I.read_lines(spark, folder)).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert reasons == {"malformed": 2, "no_customer": 2}


def test_arrival_sequence_over_blocks(spark, folder):
    """The sequence follows file and line order however the files are split."""
    for name in "abc":
        with open(os.path.join(folder, name), "w") as f:
            f.writelines(f"{name}{i:04d}\n" for i in range(2000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = I.read_lines(spark, folder).orderBy("arrival_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["arrival_seq"] for r in rows] == list(range(6000))
    assert [r["value"] for r in rows] == sorted(r["value"] for r in rows)


def test_tables_are_idempotent(spark, folder):
    from builders import frame, txn

    txns = frame(spark, [txn(1, 0, 10), txn(2, 90_000, 20)]).withColumns(
        {"currency": F.lit(None).cast("string"), "location": F.lit("Lagos"), "balance_after": F.lit(1.0)}
    )
    for _ in range(2):
        sinks.write_transactions(txns, f"{folder}/t")
    stored = sinks.read_transactions(spark, f"{folder}/t")
    assert stored.count() == 2 and stored.first()["currency"] == "NGN"


def test_text(spark):
    texts = [
        ("<think>FILE STR\nmaybe</think>\n dismiss it ", "DISMISS"), ("<think>file str", "FILE STR"),
        ("Enhanced monitoring or dismiss", "ENHANCED MONITORING"), ("nothing", "ENHANCED MONITORING"),
    ]
    rows = spark.createDataFrame(texts, "text string, expected string").select(
        strip_reasoning("text").alias("answer"), recommendation(strip_reasoning("text")).alias("got"), "expected"
    ).collect()
    assert [r["got"] for r in rows] == [r["expected"] for r in rows]
    assert rows[0]["answer"] == "dismiss it" and rows[1]["answer"].startswith("<think>")


def test_a_customer_s_reports_are_one_file(spark, folder):
    reports = spark.range(400).select(F.concat(F.lit("T"), "id").alias("transaction_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("C"), F.col("id") % 5)).alias("customer_id"))
    sinks.write_reports(reports.repartition(8), f"{folder}/reports")
    files = [d for d, _, names in os.walk(f"{folder}/reports") for n in names if n.endswith(".json")]
    assert len(files) == len(set(files)) == 5
    assert sorted(map(tuple, sinks.read_reports(spark, f"{folder}/reports", reports.schema).drop("investigated_at").collect()), key=repr) == sorted(map(tuple, reports.collect()), key=repr)
