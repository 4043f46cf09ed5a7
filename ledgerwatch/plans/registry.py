"""Regulatory text of the per-transaction rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REGISTRY_SCHEMA = (
    "rule string, severity string, regulatory_reference string, legal_consequence string, recommended_action string"
)

# Severity, reference, consequence and action of every rule.
REGISTRY = [
    (
        "NFIU_THRESHOLD_APPROACH", "HIGH",
        "MLPPA 2022, Section 2 — mandatory NFIU reporting for cash transactions exceeding ₦5,000,000 (individuals) / ₦10,000,000 (corporates)",
        "Failure to file mandatory report within 7 days: ₦250,000–₦1,000,000/day fine",
        "Escalate to MLRO. File STR with NFIU within 7 days.",
    ),
    (
        "DAILY_ATM_BREACH", "HIGH",
        "CBN Circular FPRD/DIR/PUB/CIR/001/011 (effective Jan 1 2026) — ATM cap ₦100,000/day",
        "3% excess withdrawal fee on breach amount, split 40% CBN / 60% bank",
        "Apply excess fee. Notify customer via SMS/USSD.",
    ),
    (
        "TRANSFER_VELOCITY", "HIGH",
        "MLPPA 2022, Section 2(2) — structuring prohibition",
        "Criminal offence independent of whether funds are proven illicit",
        "Freeze outbound transfers. Initiate EDD review.",
    ),
    (
        "WEEKLY_WITHDRAWAL_BREACH", "HIGH",
        "CBN Circular FPRD/DIR/PUB/CIR/001/011 — weekly cap ₦500,000 individual / ₦5,000,000 corporate",
        "3%/5% excess withdrawal fee; monthly CBN reporting required",
        "Apply excess fee. Notify customer.",
    ),
    (
        "STRUCTURING_DETECTED", "HIGH",
        "MLPPA 2022, Section 2(2) — splitting transactions to evade threshold",
        "Criminal offence under MLPPA 2022",
        "Freeze account. File STR with NFIU within 7 days.",
    ),
    (
        "BURST_PATTERN", "MEDIUM",
        "CBN AML/CFT/CPF Regulations 2022 — unusual transaction velocity",
        "Potential account takeover. Institutional liability for inadequate monitoring.",
        "Trigger OTP re-authentication. Alert account owner.",
    ),
    (
        "KYC_TIER1_BREACH", "HIGH",
        "CBN Tiered KYC Framework — Tier 1 daily limit ₦30,000",
        "CDD/KYC breach; per-day administrative penalties",
        "Block transaction. Prompt customer to complete KYC Tier 3+.",
    ),
    (
        "ROUND_AMOUNT_PATTERN", "MEDIUM",
        "FATF/NFIU layering typology — CBN AML/CFT/CPF Regulations 2022",
        "Layering red flag; feeds into STR obligation if suspicion substantiated",
        "Flag for enhanced due diligence.",
    ),
    (
        "LATE_NIGHT_HIGH_VALUE", "MEDIUM",
        "MLPPA 2022, Sections 7-10 — CDD risk profile consistency",
        "Unaddressed pattern cited as inadequate ongoing monitoring in CBN examination",
        "Trigger OTP verification. Log for CDD review.",
    ),
]

# Texts of an alert without a rule, and of a rule missing from the registry.
MODEL_ONLY = {
    "regulatory_reference": "No hard rule triggered — ML anomaly detection flag",
    "legal_consequence": "Review warranted based on behavioral pattern",
    "recommended_action": "Enhanced monitoring. Escalate to MLRO if pattern persists.",
}
UNREGISTERED = {
    "regulatory_reference": "N/A",
    "legal_consequence": "N/A",
    "recommended_action": "Review and escalate if warranted.",
}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, REGISTRY_SCHEMA)
