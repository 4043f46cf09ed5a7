"""Evidence for case review: histories, breakdowns and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import major_units, naira
from ..functions.text import recommendation, strip_reasoning

LINES = 10
NO_HISTORY = "No recent transaction history available."


def recent_history(txns: DataFrame, rows: int = LINES) -> DataFrame:
    """Each customer's last rows by arrival. The rank filter runs before the shuffle as well, so a
    busy customer sends only ``rows`` rows per map task."""
    latest = Window.partitionBy("customer_id").orderBy(F.col("arrival_seq").desc())
    return (
        txns.select("customer_id", "transaction_id", "account_id", "amount", "type", "channel", "event_ts", "arrival_seq")
        .withColumn("place", F.row_number().over(latest))
        .where(F.col("place") <= rows)
    )


def history_summary(txns: DataFrame) -> DataFrame:
    """Count, total and a text with the last ten rows, per customer."""
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("  "), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm")),
        F.col("account_id"),
        naira(F.col("amount"), 12),
        F.concat_ws(" via ", "type", "channel"),
    )
    # At most ten rows per customer reach this aggregate.
    lines = recent_history(txns).groupBy("customer_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("arrival_seq", line.alias("line")))), lambda r: r["line"]
        ).alias("_lines")
    )
    totals = txns.groupBy("customer_id").agg(
        F.count("*").alias("transactions"), F.sum("amount_minor").alias("_total")
    )
    total = major_units("_total")
    head = F.array(
        F.concat(F.lit("Total transactions: "), F.col("transactions")),
        F.concat(F.lit("Combined amount: "), naira(total)),
        F.lit(""),
    )
    return totals.join(lines, "customer_id").select(
        "customer_id", "transactions", total.alias("combined_amount"),
        F.array_join(F.concat(head, F.col("_lines")), "\n").alias("summary"),
    )


def account_breakdown(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per listed account: rows, total, the customer's total and its multiple of the reporting
    threshold. ``accounts``: customer_id, account_id. Accounts without rows stay, with zeros."""
    own = txns.groupBy("customer_id", "account_id").agg(
        F.count("*").alias("transactions"), F.sum("amount_minor").alias("_total")
    )
    listed = accounts.join(own, ["customer_id", "account_id"], "left").withColumns(
        {"transactions": F.coalesce("transactions", F.lit(0)), "_total": F.coalesce("_total", F.lit(0))}
    )
    combined = listed.groupBy("customer_id").agg(F.sum("_total").alias("_all"))
    return listed.join(combined, "customer_id").select(
        "customer_id", "account_id", F.col("transactions").cast("bigint").alias("transactions"),
        major_units("_total").alias("total"),
        major_units("_all").alias("combined_total"),
        (major_units("_all") / S.REPORTING_THRESHOLD).alias("threshold_multiple"),
    )


def breakdown_text(breakdown: DataFrame) -> DataFrame:
    """The breakdown of each customer as text."""
    line = F.concat(
        F.lit("  "), "account_id", F.lit(": "), "transactions", F.lit(" transactions | "), naira(F.col("total")), F.lit(" total")
    )
    return breakdown.groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.struct("account_id", line.alias("line")))).alias("_lines"),
        F.first("combined_total").alias("_all"), F.first("threshold_multiple").alias("_times"),
    ).select(
        "customer_id",
        F.concat(
            F.array_join(F.transform("_lines", lambda r: r["line"]), "\n"),
            F.lit("\n\n  COMBINED TOTAL: "), naira(F.col("_all")),
            F.lit("\n  VS NFIU THRESHOLD: "), F.format_number("_times", 2), F.lit("x the ₦5,000,000 limit"),
        ).alias("breakdown"),
    )


def top_alert(scored: DataFrame, rows: int = 1) -> DataFrame:
    """Highest score; the earlier arrival on ties."""
    return scored.orderBy(F.col("risk_score").desc(), "arrival_seq").limit(rows)


def high_alert_candidates(scored: DataFrame, first_rows: int = 500, from_score: float = 85) -> DataFrame:
    """High alerts among the first rows by arrival."""
    return scored.orderBy("arrival_seq").limit(first_rows).where(
        (F.col("risk_tier") == "HIGH") & (F.col("risk_score") >= from_score)
    )


def alert_history(txns: DataFrame, alerts: DataFrame) -> DataFrame:
    """All transactions of the alerts' customers."""
    return txns.join(alerts.select("customer_id").distinct(), "customer_id", "left_semi")


def case_report(alerts: DataFrame, txns: DataFrame, narratives: DataFrame) -> DataFrame:
    """One report per alert, also where the customer has no history. ``narratives``: transaction_id and the analyst's texts
    pattern_analysis, cross_account_analysis, risk_assessment, str_draft; no model is called here."""
    customers = alerts.select("customer_id").distinct()
    history = txns.join(customers, "customer_id", "left_semi")
    accounts = history.groupBy("customer_id", "account_id").count().groupBy("customer_id").agg(
        F.array_sort(F.collect_set("account_id")).alias("all_accounts")
    )
    several = F.coalesce(F.size("all_accounts") > 1, F.lit(False))
    verdict = recommendation(strip_reasoning("risk_assessment"))
    alert = F.struct(*[c for c in alerts.columns if c not in ("arrival_seq", "event_ts", "is_suspicious")])
    return (
        alerts.join(accounts, "customer_id", "left")
        .join(history_summary(history).select("customer_id", "summary"), "customer_id", "left")
        .join(narratives, "transaction_id", "left")
        .select(
            "transaction_id", "customer_id", "account_id", alert.alias("alert"),
            F.coalesce("all_accounts", F.array().cast("array<string>")).alias("all_accounts"),
            F.coalesce("summary", F.lit(NO_HISTORY)).alias("history"),
            F.struct(
                "pattern_analysis",
                F.when(several, F.col("cross_account_analysis")).alias("cross_account_analysis"),
                strip_reasoning("risk_assessment").alias("risk_assessment"),
            ).alias("steps"),
            F.when(verdict == "FILE STR", F.col("str_draft")).alias("str_draft"),
            verdict.alias("final_recommendation"),
            F.lit("PENDING").alias("mlro_decision"),
        )
    )
