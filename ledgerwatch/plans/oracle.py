"""DuckDB counterparts of the catalogue, written from the definitions: a window is a self-join."""

from __future__ import annotations

from .. import schema as S
from ..operators.accounts import ACCOUNT_COLUMNS
from ..operators.graph_model import random_weights
from . import rules as R
from .catalog import FEATURE_GROUPS, NEIGHBOR_COLUMNS, PROFILED, RULE_KEYS
from .registry import MODEL_ONLY, REGISTRY

TXN = """
ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k, user_id // 3 AS owner FROM events),
txn AS (
  SELECT 'TXN-' || event_id AS transaction_id, 'ACC-' || user_id AS account_id, 'CUST-' || owner AS customer_id,
    CASE WHEN owner % 5 <= 1 THEN 'TIER_1' WHEN owner % 5 <= 3 THEN 'TIER_2' ELSE 'TIER_3' END AS account_tier,
    CASE k % 10 WHEN 0 THEN round(value * 25000, 2) WHEN 1 THEN round(90000 + value * 20, 2)
      WHEN 2 THEN 10000 * (1 + floor(value / 50)) ELSE round(value * 1000, 2) END AS amount,
    CASE WHEN event_type IN ('click', 'error') THEN 'transfer' WHEN event_type IN ('view', 'purchase') THEN 'withdrawal'
      WHEN k % 2 = 0 THEN 'airtime' ELSE 'bill_payment' END AS type,
    CASE WHEN k % 10 = 1 THEN 'ATM' ELSE ['ATM', 'mobile', 'POS', 'USSD'][event_id % 4 + 1] END AS channel,
    ['Lagos', 'Abuja', 'Ibadan', 'Port Harcourt', 'Kano'][event_id % 5 + 1] AS location,
    'NGN' AS currency, round(value * 5000, 2) AS balance_after,
    k IN (0, 1, 10, 11, 20) AS is_suspicious,
    CASE WHEN k IN (0, 20) THEN 'structuring' WHEN k = 1 THEN 'cross_account_structuring' WHEN k = 10 THEN 'burst'
      WHEN k = 11 THEN 'late_night' END AS suspicious_typology,
    ts AS event_ts, epoch_us(ts) AS ts_us, event_id AS arrival_seq, k, user_id,
    CAST(k AS DECIMAL(9,4)) / 100 AS iso_raw,
    CAST(k * 100 AS BIGINT) AS iso_bp, CAST((event_id % 1000) * 10 AS BIGINT) AS rf_bp,
    CAST(((user_id * 37 + k) % 100) * 100 AS BIGINT) AS gnn_bp
  FROM ev),
t AS (SELECT *, CAST(round(amount * 100) AS BIGINT) AS m FROM txn)"""

LATE = """,
late AS (SELECT * REPLACE ((arrival_seq + 7 * (k % 5)) * 5 + (4 - k % 5) AS arrival_seq) FROM t)"""

# Scores are whole ten-thousandths, so the fused score is exact integer arithmetic up to the rounding.
FUSED = """,
fused AS (
  SELECT *, ((15 * iso_bp + 40 * rf_bp + 45 * gnn_bp + 500) // 1000) / 10.0 / 1.0 AS risk_score FROM t),
f AS (SELECT *, CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier FROM fused)"""


def feature_ctes(base: str = "t") -> str:
    """Features of every row from all pairs with an earlier arrival of the same customer."""
    us = {"60s": S.MINUTE, "1h": S.HOUR, "6h": 6 * S.HOUR, "24h": S.DAY, "7d": S.WEEK}
    win = lambda expr, w: f"{expr} FILTER (x.ts_us >= r.ts_us - {us[w]})"
    return f""",
pairs AS (
  SELECT r.arrival_seq AS rid, count(*) AS n_all, CAST(sum(x.m) AS BIGINT) AS tot, stddev_pop(x.amount) AS std_all,
    max(x.amount) AS max_all, min(x.amount) AS min_all,
    count(DISTINCT x.account_id) AS accounts, arg_min(x.ts_us, x.arrival_seq) AS first_us,
    arg_max(x.ts_us, x.arrival_seq) FILTER (x.arrival_seq < r.arrival_seq) AS prev_us,
    {win('count(*)', '60s')} AS n_60s, {win('count(*)', '1h')} AS n_1h, {win('count(*)', '24h')} AS n_24h,
    {', '.join(f"CAST({win('sum(x.m)', w)} AS BIGINT) / 100.0 AS s_{w}" for w in ('1h', '6h', '24h', '7d'))},
    {win('max(x.amount)', '24h')} AS max_24h, {win('stddev_pop(x.amount)', '24h')} AS std_24h,
    {win('count(DISTINCT x.account_id)', '24h')} AS accounts_24h,
    count(*) FILTER (x.ts_us >= r.ts_us - {S.DAY} AND CAST(trunc(x.amount) AS BIGINT) % 10000 = 0) AS round_24h
  FROM {base} r JOIN {base} x ON r.customer_id = x.customer_id AND x.arrival_seq <= r.arrival_seq GROUP BY r.arrival_seq),
channels AS (
  SELECT r.arrival_seq AS rid, x.channel AS usual_channel,
    row_number() OVER (PARTITION BY r.arrival_seq ORDER BY count(*) DESC, min(x.arrival_seq)) AS place
  FROM {base} r JOIN {base} x ON r.customer_id = x.customer_id AND x.arrival_seq <= r.arrival_seq GROUP BY r.arrival_seq, x.channel),
hours AS (
  SELECT r.arrival_seq AS rid, hour(x.event_ts) AS usual_hour,
    row_number() OVER (PARTITION BY r.arrival_seq ORDER BY count(*) DESC, min(x.arrival_seq)) AS place
  FROM {base} r JOIN {base} x ON r.customer_id = x.customer_id AND x.arrival_seq <= r.arrival_seq GROUP BY r.arrival_seq, hour(x.event_ts)),
feat AS (
  SELECT b.transaction_id, b.account_id, b.customer_id, b.account_tier, b.type, b.channel, b.event_ts, b.arrival_seq, b.amount,
    b.iso_bp, b.rf_bp, b.gnn_bp,
    ln(1 + amount) AS amount_log, amount / 5000000 AS threshold_proximity,
    1 - abs(amount - round_even(amount / 100, 0) * 100) / greatest(amount, 1) AS amount_roundness,
    CAST(amount >= 4500000 AND amount < 5000000 AS INT) AS is_near_threshold,
    CAST(amount > 100000 AND b.channel = 'ATM' AS INT) AS exceeds_atm_daily,
    CAST(amount > 30000 AND account_tier = 'TIER_1' AS INT) AS exceeds_tier1_daily,
    hour(event_ts) AS hour_of_day, CAST(hour(event_ts) BETWEEN 1 AND 4 AS INT) AS is_late_night,
    CAST(isodow(event_ts) >= 6 AS INT) AS is_weekend,
    coalesce((ts_us - prev_us) / 1e6, -1.0) AS inter_txn_interval_seconds,
    n_24h AS daily_txn_count, n_1h AS hourly_txn_count, n_24h / 24.0 AS daily_velocity,
    tot / 100.0 / n_all AS mean_so_far, CASE WHEN n_all < 2 THEN 0 ELSE std_all END AS std_so_far, max_all AS max_so_far,
    min_all AS min_so_far, n_all AS txns_so_far,
    amount / greatest(tot / 100.0 / n_all, 1) AS amount_vs_customer_mean,
    (amount - tot / 100.0 / n_all) / CASE WHEN n_all < 2 OR min_all = max_all THEN 1 ELSE std_all END AS amount_zscore,
    CAST(b.channel = usual_channel AS INT) AS channel_consistency, CAST(abs(hour(event_ts) - usual_hour) <= 2 AS INT) AS hour_consistency,
    s_1h AS sum_1h, s_24h AS sum_24h, s_7d AS sum_7d, n_1h AS count_1h, n_24h AS count_24h,
    s_24h AS cross_account_sum_24h, s_24h / 5000000 AS cross_account_threshold_ratio,
    s_6h AS cross_account_sum_6h, s_6h / 5000000 AS cross_account_ratio_6h,
    max_24h AS max_single_24h, CASE WHEN n_24h > 1 THEN std_24h / greatest(s_24h / n_24h, 1) ELSE 0.0 END AS cov_24h,
    accounts AS accounts_per_customer, CAST(floor((ts_us - first_us) / 86400000000) AS BIGINT) AS account_age_days,
    accounts_24h AS unique_counterparties_24h,
    CASE account_tier WHEN 'TIER_1' THEN 1 WHEN 'TIER_2' THEN 2 WHEN 'TIER_3' THEN 3 ELSE 0 END AS tier_numeric,
    CASE b.channel WHEN 'ATM' THEN 0 WHEN 'mobile' THEN 1 WHEN 'POS' THEN 2 WHEN 'USSD' THEN 3 ELSE -1 END AS channel_numeric,
    CASE type WHEN 'withdrawal' THEN 0 WHEN 'transfer' THEN 1 WHEN 'bill_payment' THEN 2 WHEN 'airtime' THEN 3 ELSE -1 END AS type_numeric,
    CAST(is_suspicious AS INT) AS is_suspicious, coalesce(suspicious_typology, 'normal') AS suspicious_typology, n_60s, round_24h
  FROM {base} b JOIN pairs p ON p.rid = b.arrival_seq
    JOIN channels c ON c.rid = b.arrival_seq AND c.place = 1 JOIN hours h ON h.rid = b.arrival_seq AND h.place = 1)"""


FLOATS = {
    "amount", "amount_log", "threshold_proximity", "amount_roundness", "inter_txn_interval_seconds", "daily_velocity",
    "amount_vs_customer_mean", "amount_zscore", "sum_1h", "sum_24h", "sum_7d", "cross_account_sum_24h",
    "cross_account_threshold_ratio", "cross_account_sum_6h", "cross_account_ratio_6h", "max_single_24h", "cov_24h",
}


def six(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in FLOATS else c for c in columns)


RULES = """,
ruled AS (
  SELECT *, list_filter([
    CASE WHEN sum_24h > 4500000 THEN 'NFIU_THRESHOLD_APPROACH' END,
    CASE WHEN channel = 'ATM' AND type = 'withdrawal' AND amount > 100000 THEN 'DAILY_ATM_BREACH' END,
    CASE WHEN n_60s >= 5 THEN 'BURST_PATTERN' END,
    CASE WHEN count_24h >= 3 AND sum_24h > 4250000 AND amount < 5000000 THEN 'STRUCTURING_DETECTED' END,
    CASE WHEN type = 'withdrawal' AND sum_7d > 500000 THEN 'WEEKLY_WITHDRAWAL_BREACH' END,
    CASE WHEN is_late_night = 1 AND type = 'withdrawal' AND amount > 50000 THEN 'LATE_NIGHT_HIGH_VALUE' END,
    CASE WHEN type = 'transfer' AND count_1h >= 5 THEN 'TRANSFER_VELOCITY' END,
    CASE WHEN account_tier = 'TIER_1' AND amount > 30000 THEN 'KYC_TIER1_BREACH' END,
    CASE WHEN type = 'transfer' AND round_24h >= 3 THEN 'ROUND_AMOUNT_PATTERN' END], lambda x: x IS NOT NULL) AS rules
  FROM feat)"""


SCALED = """,
ordered AS (SELECT *, row_number() OVER (ORDER BY arrival_seq) <= floor((SELECT count(*) FROM feat) * 0.75) AS train FROM feat),
st AS (SELECT """ + ", ".join(
    f"avg({c}) FILTER (train) AS mean_{c}, coalesce(nullif(stddev_pop({c}) FILTER (train), 0), 1) AS std_{c}" for c in S.FEATURE_COLUMNS
) + """ FROM ordered),
scaled AS (SELECT transaction_id, train, is_suspicious, """ + ", ".join(
    f"({c} - mean_{c}) / std_{c} AS {c}" for c in S.FEATURE_COLUMNS
) + """ FROM ordered CROSS JOIN st)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


REG = ", reg(rule, severity, regulatory_reference, legal_consequence, recommended_action) AS (VALUES " + ", ".join(
    "(" + ", ".join(quoted(c) for c in row) + ")" for row in REGISTRY
) + ")"

ALERTS = REG + """,
al AS (
  SELECT r.transaction_id, r.account_id, r.customer_id, r.account_tier, round(r.amount, 6) AS amount,
    strftime(r.event_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp,
    iso_bp / 10000.0 AS iso_score, rf_bp / 10000.0 AS rf_score, gnn_bp / 10000.0 AS gnn_score,
    f.risk_score, f.risk_tier, array_to_string(r.rules, ',') AS triggered_rules, r.arrival_seq, {texts}
  FROM ruled r JOIN (SELECT transaction_id, risk_score, risk_tier FROM f) f USING (transaction_id) LEFT JOIN reg ON reg.rule = r.rules[1])""".replace(
    "{texts}", ", ".join(f"coalesce(reg.{c}, {quoted(v)}) AS {c}" for c, v in MODEL_ONLY.items())
)


# Window rules: the predicates and limits again, as SQL.
ATM = "channel = 'ATM' AND type = 'withdrawal'"
PREDICATES = {
    "DAILY_ATM_BREACH": ATM,
    "WEEKLY_WITHDRAWAL_BREACH": "type = 'withdrawal'",
    "BURST_PATTERN": "true",
    "STRUCTURING_DETECTED": ATM + " AND amount >= 90000 AND amount <= 99999",
    "NFIU_THRESHOLD_APPROACH": "(type = 'transfer' OR type = 'withdrawal')",
    "LATE_NIGHT_HIGH_VALUE": "type = 'withdrawal' AND amount > 50000 AND hour(event_ts) >= 1 AND hour(event_ts) <= 4",
    "TRANSFER_VELOCITY": "type = 'transfer'",
    "KYC_TIER1_BREACH": "account_tier = 'TIER_1'",
    "ROUND_AMOUNT_PATTERN": "type = 'transfer' AND CAST(trunc(amount) AS BIGINT) % 10000 = 0",
}
TEST_PREDICATES = {
    "STRUCTURING_DETECTED": ATM + " AND amount >= 900 AND amount <= 99999",
    "LATE_NIGHT_HIGH_VALUE": "type = 'withdrawal' AND amount > 500",
}
SEVERITY = {"LATE_NIGHT_HIGH_VALUE": "MEDIUM", "TRANSFER_VELOCITY": "MEDIUM", "ROUND_AMOUNT_PATTERN": "MEDIUM"}
MIN, HOUR, DAY, WEEK = "1 minute", "1 hour", "24 hours", "7 days"
PRODUCTION = {
    "DAILY_ATM_BREACH": (DAY, "sum(m) > 10000000"),
    "WEEKLY_WITHDRAWAL_BREACH": (WEEK, "sum(m) > 50000000"),
    "BURST_PATTERN": (MIN, "count(*) >= 3"),
    "STRUCTURING_DETECTED": (DAY, "count(*) >= 3"),
    "NFIU_THRESHOLD_APPROACH": (DAY, "sum(m) > 450000000"),
    "LATE_NIGHT_HIGH_VALUE": None,
    "TRANSFER_VELOCITY": (HOUR, "count(*) >= 5 AND avg(amount) < 100000"),
    "KYC_TIER1_BREACH": (DAY, "sum(m) > 3000000"),
    "ROUND_AMOUNT_PATTERN": (DAY, "count(*) >= 3"),
}
WIDE = PRODUCTION | {
    "BURST_PATTERN": ("6 hours", "count(*) >= 3"),
    "STRUCTURING_DETECTED": (WEEK, "count(*) >= 2"),
    "TRANSFER_VELOCITY": (DAY, "count(*) >= 3 AND avg(amount) < 100000"),
    "ROUND_AMOUNT_PATTERN": (WEEK, "count(*) >= 2"),
}
TWO = "2 minutes"
TEST = {
    "DAILY_ATM_BREACH": (TWO, "sum(m) > 100000"),
    "WEEKLY_WITHDRAWAL_BREACH": (TWO, "sum(m) > 200000"),
    "BURST_PATTERN": (MIN, "count(*) >= 3"),
    "STRUCTURING_DETECTED": (TWO, "count(*) >= 2"),
    "NFIU_THRESHOLD_APPROACH": (TWO, "sum(m) > 500000"),
    "LATE_NIGHT_HIGH_VALUE": None,
    "TRANSFER_VELOCITY": (TWO, "count(*) >= 2 AND avg(amount) < 100000"),
    "KYC_TIER1_BREACH": (TWO, "sum(m) > 50000"),
    "ROUND_AMOUNT_PATTERN": (TWO, "count(*) >= 2"),
}


def rule_sql(name: str, profile: dict, predicates: dict, origin: str = "1970-01-01", right: bool = False) -> str:
    where, severity = predicates[name], SEVERITY.get(name, "HIGH")
    labels = f"'{name}' AS rule_triggered, '{severity}' AS severity"
    if profile[name] is None:
        return f"SELECT account_id, account_tier, amount AS flagged_amount, 1 AS txn_count, {labels}, event_ts AS detected_at FROM t WHERE {where}"
    width, having = profile[name]
    us = "event_ts - INTERVAL 1 microsecond" if right else "event_ts"
    bucket = f"time_bucket(INTERVAL '{width}', {us}, TIMESTAMP '{origin}')"
    return f"""SELECT account_id, account_tier, CAST(sum(m) AS BIGINT) / 100.0 AS flagged_amount, count(*) AS txn_count, {labels},
  {bucket} + INTERVAL '{width}' AS detected_at FROM t WHERE {where} GROUP BY account_id, account_tier, {bucket} HAVING {having}"""


def all_rules(profile: dict, predicates: dict = PREDICATES, **alignment) -> str:
    return f"WITH {TXN} " + " UNION ALL ".join(rule_sql(n, profile, predicates, **alignment) for n in R_NAMES)


R_NAMES = list(PRODUCTION)

ACCOUNTS = """,
acc AS (
  SELECT account_id, arg_min(customer_id, arrival_seq) AS customer_id,
    ln(1 + avg(amount)) AS log_mean_amount, ln(1 + stddev_pop(amount)) AS log_std_amount, ln(1 + max(amount)) AS log_max_amount,
    ln(1 + min(amount)) AS log_min_amount, stddev_pop(amount) / greatest(avg(amount), 1) AS cov_amount,
    max(threshold_proximity) AS max_threshold_proximity, avg(threshold_proximity) AS mean_threshold_proximity,
    ln(1 + max(cross_account_sum_24h)) AS log_max_cross_sum_24h, max(cross_account_threshold_ratio) AS max_cross_ratio_24h,
    ln(1 + max(cross_account_sum_6h)) AS log_max_cross_sum_6h, max(cross_account_ratio_6h) AS max_cross_ratio_6h,
    max(amount_zscore) AS max_zscore, max(amount_vs_customer_mean) AS max_vs_mean,
    max(daily_txn_count) * 1e0 AS max_daily_count, max(hourly_txn_count) * 1e0 AS max_hourly_count, max(daily_velocity) AS max_daily_velocity,
    avg(is_late_night) AS late_night_rate, avg(is_weekend) AS weekend_rate, avg(hour_of_day) / 24.0 AS mean_hour,
    max(exceeds_atm_daily) * 1e0 AS any_atm_breach, max(exceeds_tier1_daily) * 1e0 AS any_tier1_breach,
    max(is_near_threshold) * 1e0 AS any_near_threshold, avg(exceeds_atm_daily) + avg(exceeds_tier1_daily) AS breach_rate,
    arg_min(tier_numeric, arrival_seq) * 1e0 AS tier_numeric, arg_min(accounts_per_customer, arrival_seq) * 1e0 AS accounts_per_customer,
    ln(1 + count(*)) AS log_txn_count, avg(amount_roundness) AS mean_roundness, max(amount_roundness) AS max_roundness,
    avg(channel_consistency) AS channel_consistency, avg(channel_numeric) AS channel_numeric_mean, avg(type_numeric) AS type_numeric_mean,
    ln(1 + max(sum_1h)) AS log_max_sum_1h, ln(1 + max(sum_24h)) AS log_max_sum_24h, max(is_suspicious) AS label
  FROM feat GROUP BY account_id)"""

# The edge list pair by pair, as a check on group arithmetic.
EDGES = ACCOUNTS + """,
by_customer AS (SELECT a.account_id AS src, b.account_id AS dst FROM acc a JOIN acc b ON a.customer_id = b.customer_id AND a.account_id <> b.account_id),
by_tier AS (
  SELECT a.account_id AS src, b.account_id AS dst FROM acc a JOIN acc b ON a.tier_numeric = b.tier_numeric AND a.account_id <> b.account_id
  WHERE a.max_cross_ratio_6h > 0.5 AND b.max_cross_ratio_6h > 0.5),
linked AS (SELECT * FROM by_customer UNION SELECT * FROM by_tier),
edges AS (SELECT * FROM linked UNION ALL SELECT account_id, account_id FROM acc)"""


def doubles(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


NOTES = """
notes AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<think>' || text || '</think>' || chr(10) || ' We should file STR, not dismiss. '
    WHEN 1 THEN '<think>' || text WHEN 2 THEN text || ' Dismiss.'
    WHEN 3 THEN '<think>file str</think>' || text || ' Enhanced monitoring<think>' || chr(10) || '</think>' ELSE text END AS text FROM documents),
answers AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '<think>.*?</think>', '', 'gs'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS answer FROM notes),
verdicts AS (
  SELECT *, CASE WHEN contains(upper(answer), 'FILE STR') THEN 'FILE STR' WHEN contains(upper(answer), 'ENHANCED MONITORING') THEN 'ENHANCED MONITORING'
    WHEN contains(upper(answer), 'DISMISS') THEN 'DISMISS' ELSE 'ENHANCED MONITORING' END AS recommendation FROM answers)"""

MONEY = lambda x: f"'₦' || format('{{:,.2f}}', {x})"

HISTORY = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY arrival_seq DESC) AS place FROM t),
lines AS (
  SELECT customer_id, string_agg('  ' || strftime(event_ts, '%Y-%m-%dT%H:%M') || ' | ' || account_id || ' | ₦' ||
    lpad(format('{:,.2f}', amount), 12, ' ') || ' | ' || type || ' via ' || channel, chr(10) ORDER BY arrival_seq) AS tail
  FROM ranked WHERE place <= 10 GROUP BY customer_id),
sums AS (SELECT customer_id, count(*) AS transactions, CAST(sum(m) AS BIGINT) / 100.0 AS combined_amount FROM t GROUP BY customer_id),
history AS (
  SELECT customer_id, transactions, combined_amount, 'Total transactions: ' || transactions || chr(10) || 'Combined amount: ₦' ||
    format('{:,.2f}', combined_amount) || chr(10) || chr(10) || tail AS summary FROM sums JOIN lines USING (customer_id))"""

LATE_FUSED = """, g AS (SELECT * REPLACE ((arrival_seq + 7 * (k % 5)) * 5 + (4 - k % 5) AS arrival_seq) FROM f)"""

SNAPSHOT = """,
            a AS (SELECT customer_id, string_agg(account_id, ',' ORDER BY s) AS account_ids, count(*) AS account_count
              FROM (SELECT customer_id, account_id, min(arrival_seq) AS s FROM g GROUP BY 1, 2) GROUP BY customer_id)
            SELECT customer_id, any_value(account_ids) AS account_ids, any_value(account_count) AS account_count, arg_min(account_tier, arrival_seq) AS account_tier,
            count(*) AS total_transactions, CAST(sum(m) AS BIGINT) / 100.0 AS total_amount, round(CAST(sum(m) AS BIGINT) / 100.0 / count(*), 6) AS mean_amount,
            max(amount) AS max_amount, count(*) FILTER (is_suspicious) AS suspicious_count, count(*) FILTER (risk_score >= 40) AS alert_count,
            coalesce(arg_max(risk_score, arrival_seq) FILTER (risk_score >= 40), arg_min(risk_score, arrival_seq)) AS latest_risk_score,
            greatest(max(risk_score) FILTER (risk_score >= 40), arg_min(risk_score, arrival_seq)) AS highest_risk_score,
            coalesce(arg_max(risk_tier, arrival_seq) FILTER (risk_score >= 40), arg_min(risk_tier, arrival_seq)) AS latest_risk_tier,
            arg_min(event_ts, arrival_seq) AS first_seen, arg_max(event_ts, arrival_seq) AS last_seen FROM g JOIN a USING (customer_id) GROUP BY customer_id"""

LINES_OK = "arrival_seq % 97 <> 0 AND arrival_seq % 89 <> 0 AND arrival_seq % 83 <> 0"
TOPIC = "['transactions', 'alerts', 'audit'][k % 3 + 1]"
MESSAGES = f""",
msg AS (SELECT {TOPIC} AS topic, arrival_seq AS offset_, transaction_id, customer_id, amount FROM t),
pos AS (SELECT topic, max(offset_) + 1 AS written, CAST(floor((max(offset_) + 1) * 0.4) AS BIGINT) AS consumed, count(*) AS total FROM msg GROUP BY topic)"""

METRICS = """count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn"""
RATIOS = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy"""
Y = ", y AS (SELECT is_suspicious AS y, risk_score >= 60 AS p, risk_score, account_tier FROM f)"


HASH = "('0x' || substr(md5({}), 1, 13))::BIGINT"

SMOTE = f""", tr AS (SELECT transaction_id AS id, is_suspicious AS label, [{', '.join(S.FEATURE_COLUMNS)}]::DOUBLE[] AS v FROM scaled WHERE train),
pos AS (SELECT * FROM tr WHERE label = 1), sizes AS (SELECT count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS positives FROM tr),
partners AS (SELECT a.id, b.v AS nv, positives, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS place FROM pos a JOIN pos b ON a.id <> b.id, sizes),
near AS (SELECT id, list(nv[1] ORDER BY place) AS firsts FROM partners WHERE place <= least(5, positives - 1) GROUP BY id),
turns AS (SELECT id, v, row_number() OVER (ORDER BY {HASH.format("'42|' || id")}) AS turn FROM pos),
copies AS (SELECT id, v, unnest(range(1, (normal - positives) // positives + CASE WHEN turn <= (normal - positives) % positives THEN 1 ELSE 0 END + 1)) AS c
  FROM turns, sizes WHERE normal > positives AND positives > 1),
made AS (SELECT id, c, v[1] AS x, firsts[CAST(floor({HASH.format("'neighbour|' || id || '|' || c")} / 4503599627370496.0 * len(firsts)) AS BIGINT) + 1] AS y,
  {HASH.format("'step|' || id || '|' || c")} / 4503599627370496.0 AS step FROM copies JOIN near USING (id))
SELECT id, label, round(v[1], 6) AS amount_scaled FROM tr UNION ALL SELECT id || '~' || c, 1, round(x + step * (y - x), 6) FROM made"""


def sage_forward_sql() -> str:
    """Both layers and the softmax with the weights as lists."""
    listed = lambda m: "[" + ", ".join(listed(v) if getattr(v, "ndim", 0) else repr(float(v)) for v in m) + "]"
    layers, (w3, b3) = random_weights()[:-1], random_weights()[-1]
    sql = f""", sx AS (SELECT account_id, [{', '.join(f'(({c} - m_{c}) / s_{c})::DOUBLE' for c in ACCOUNT_COLUMNS)}] AS x FROM acc CROSS JOIN
      (SELECT {', '.join(f'avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}' for c in ACCOUNT_COLUMNS)} FROM acc)), h0 AS (SELECT * FROM sx)"""
    for k, (near, own, bias) in enumerate(layers):
        inputs, width = near.shape
        sql += f""", w{k} AS (SELECT {listed(near.T)}::DOUBLE[][] AS a, {listed(own.T)}::DOUBLE[][] AS b, {listed(bias)}::DOUBLE[] AS c),
          n{k} AS (SELECT src AS account_id, [{', '.join(f'avg(x[{i + 1}])' for i in range(inputs))}] AS near FROM edges JOIN h{k} ON account_id = dst GROUP BY src),
          h{k + 1} AS (SELECT account_id, list_transform(range(1, {width + 1}), lambda i: greatest(0.0, list_dot_product(near, a[i]) + list_dot_product(x, b[i]) + c[i])) AS x
            FROM n{k} JOIN h{k} USING (account_id), w{k})"""
    difference = f"list_dot_product(x, {listed((w3[:, 0] - w3[:, 1]))}::DOUBLE[]) + {float(b3[0] - b3[1])!r}"
    return sql + f" SELECT account_id, round(1 / (1 + exp({difference})), 6) AS gnn_score FROM h{len(layers)}"


def oracles() -> dict[str, str]:
    txn = f"WITH {TXN} "
    fused = f"WITH {TXN}{FUSED} "
    feat = f"WITH {TXN}{feature_ctes()} "
    late = f"WITH {TXN}{LATE}{feature_ctes('late')} "
    ruled = f"WITH {TXN}{FUSED}{feature_ctes()}{RULES}{ALERTS} "
    accounts = f"WITH {TXN}{feature_ctes()}{ACCOUNTS} "
    edges = f"WITH {TXN}{feature_ctes()}{EDGES} "
    messages = f"WITH {TXN}{MESSAGES} "
    full = [*S.FEATURE_COLUMNS, *S.LABEL_COLUMNS, *S.ID_COLUMNS]
    alert_columns = [
        "transaction_id", "account_id", "customer_id", "account_tier", "amount", "iso_score", "rf_score", "gnn_score",
        "risk_score", "risk_tier", "triggered_rules", *MODEL_ONLY,
    ]
    queries = {
        "ingest_valid_rows": txn + f"SELECT transaction_id, customer_id, amount, channel, is_suspicious FROM t WHERE {LINES_OK}",
        "ingest_rejected": txn + """SELECT CASE WHEN arrival_seq % 89 = 0 THEN 'malformed' ELSE 'no_customer' END AS reason, count(*) AS lines
            FROM t WHERE arrival_seq % 97 <> 0 AND (arrival_seq % 89 = 0 OR arrival_seq % 83 = 0) GROUP BY 1""",
        "parse_event_time": txn + f"SELECT transaction_id, event_ts FROM t WHERE {LINES_OK} AND arrival_seq % 71 <> 0",
        "publish_envelope": messages + 'SELECT topic, offset_ AS "offset", transaction_id, customer_id, amount FROM msg',
        "topic_slice": messages + """SELECT topic, offset_ AS "offset", transaction_id FROM msg JOIN pos USING (topic)
            WHERE topic IN ('transactions', 'alerts') AND offset_ >= consumed""",
        "topic_poll": messages + """SELECT topic, offset_ AS "offset", transaction_id FROM msg JOIN pos USING (topic)
            WHERE offset_ >= consumed ORDER BY offset_ LIMIT 100""",
        "topic_backlog": messages + "SELECT topic, total, greatest(0, written - consumed) AS pending FROM pos",
        "transactions_upsert": txn + """SELECT transaction_id, account_id, customer_id, account_tier,
            amount + CASE WHEN arrival_seq % 4 = 0 THEN 1 ELSE 0 END AS amount, currency, type AS txn_type,
            CASE WHEN arrival_seq % 7 = 0 THEN 'mobile' ELSE channel END AS channel, location, balance_after, event_ts AS txn_timestamp,
            is_suspicious, suspicious_typology FROM t""",
        "alerts_sink": ruled + f"SELECT {', '.join(alert_columns)}, false AS reviewed, 'PENDING' AS mlro_decision FROM al WHERE risk_score >= 40",
        "high_alert_feed": ruled + "SELECT transaction_id, account_id, customer_id, risk_score, amount, triggered_rules FROM al WHERE risk_tier = 'HIGH'",
        "features_sink": feat + "SELECT " + ", ".join(f"round({c} * 1e0, 6) AS {c}" for c in S.FEATURE_COLUMNS)
            + f", {', '.join([*S.LABEL_COLUMNS, *S.ID_COLUMNS])} FROM feat",
        "scalar_amount_features": feat + f"SELECT transaction_id, {six(S.FEATURE_COLUMNS[1:7])} FROM feat",
        "scalar_temporal_features": txn + """SELECT transaction_id, hour(event_ts) AS hour_of_day,
            CAST(hour(event_ts) BETWEEN 1 AND 4 AS INT) AS is_late_night, CAST(isodow(event_ts) >= 6 AS INT) AS is_weekend FROM t""",
        "categorical_encoding": txn + """SELECT transaction_id,
            CASE WHEN arrival_seq % 17 = 0 THEN 0 ELSE CAST(right(account_tier, 1) AS INT) END AS tier_numeric,
            CASE WHEN arrival_seq % 11 = 0 THEN -1 ELSE list_position(['ATM', 'mobile', 'POS', 'USSD'], channel) - 1 END AS channel_numeric,
            CASE WHEN arrival_seq % 13 = 0 THEN -1 ELSE list_position(['withdrawal', 'transfer', 'bill_payment', 'airtime'], type) - 1 END AS type_numeric
            FROM t""",
        "text_recommendation": f"WITH {NOTES} SELECT doc_id, length(answer) AS answer_length, md5(answer) AS answer_md5, recommendation FROM verdicts",
        "risk_tiering": txn + """SELECT transaction_id, CASE WHEN rf_bp >= 7000 THEN 'HIGH' WHEN rf_bp >= 4000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
            round(least(1, k / 50.0 / 1.5), 6) AS iso_normalised FROM t""",
        "features_full": feat + f"SELECT {six(full)} FROM feat",
        "features_arrival_order": late + f"SELECT {six(full)} FROM feat",
        "alerts_missing_fields": f"""WITH {TXN}{FUSED}, gap AS (SELECT * REPLACE (
              CASE WHEN arrival_seq % 5 <> 0 THEN account_tier ELSE 'TIER_2' END AS account_tier, CASE WHEN arrival_seq % 7 <> 0 THEN channel ELSE 'mobile' END AS channel,
              CASE WHEN arrival_seq % 11 <> 0 THEN type ELSE 'transfer' END AS type, CASE WHEN arrival_seq % 13 <> 0 THEN customer_id ELSE 'UNKNOWN' END AS customer_id)
              FROM t){feature_ctes("gap")}{RULES}
            SELECT gap.transaction_id, gap.account_id, gap.customer_id, CASE WHEN gap.arrival_seq % 5 <> 0 THEN gap.account_tier ELSE 'UNKNOWN' END AS account_tier,
            f.risk_score, f.risk_tier, array_to_string(ruled.rules, ',') AS triggered_rules
            FROM ruled JOIN gap USING (transaction_id) JOIN f ON f.transaction_id = gap.transaction_id""",
        "txn_rules": feat.rstrip() + RULES + " SELECT transaction_id, array_to_string(rules, ',') AS triggered_rules FROM ruled",
        "account_features": accounts + f"SELECT account_id, customer_id, label, {doubles(ACCOUNT_COLUMNS)} FROM acc",
        "account_features_serving": feat.rstrip() + f""", l AS (
            SELECT *, sum_24h / 5000000 AS r FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY arrival_seq DESC) AS place FROM feat) WHERE place = 1),
            v AS (SELECT account_id, customer_id, ln(1 + mean_so_far) AS log_mean_amount, ln(1 + std_so_far) AS log_std_amount, ln(1 + max_so_far) AS log_max_amount,
            ln(1 + min_so_far) AS log_min_amount, std_so_far / greatest(mean_so_far, 1) AS cov_amount, r AS max_threshold_proximity, r AS mean_threshold_proximity,
            ln(1 + sum_24h) AS log_max_cross_sum_24h, r AS max_cross_ratio_24h, ln(1 + cross_account_sum_6h) AS log_max_cross_sum_6h,
            cross_account_ratio_6h AS max_cross_ratio_6h, (max_so_far - mean_so_far) / greatest(std_so_far, 1) AS max_zscore,
            max_so_far / greatest(mean_so_far, 1) AS max_vs_mean, count_24h * 1e0 AS max_daily_count, count_1h * 1e0 AS max_hourly_count,
            count_24h / 24.0 AS max_daily_velocity, 0e0 AS late_night_rate, 0e0 AS weekend_rate, hour_of_day / 24.0 AS mean_hour,
            0e0 AS any_atm_breach, 0e0 AS any_tier1_breach, 0e0 AS any_near_threshold, 0e0 AS breach_rate, accounts_per_customer * 1e0 AS tier_numeric,
            accounts_per_customer * 1e0 AS accounts_per_customer, ln(1 + txns_so_far) AS log_txn_count, 5e-1 AS mean_roundness, 5e-1 AS max_roundness,
            5e-1 AS channel_consistency, 15e-1 AS channel_numeric_mean, 15e-1 AS type_numeric_mean, ln(1 + sum_1h) AS log_max_sum_1h, ln(1 + sum_24h) AS log_max_sum_24h FROM l)
            SELECT account_id, customer_id, {doubles(ACCOUNT_COLUMNS)} FROM v""",
        "edges_shared_customer": edges + "SELECT account_id, count(dst) AS customer_neighbours FROM acc LEFT JOIN by_customer ON src = account_id GROUP BY account_id",
        "edges_coordinated": edges + "SELECT account_id, count(dst) AS tier_neighbours FROM acc LEFT JOIN by_tier ON src = account_id GROUP BY account_id",
        "edges_full": edges + "SELECT src AS account_id, count(*) - 1 AS neighbours, count(*) AS edges_out FROM edges GROUP BY src",
        "graph_stats": edges + f"""SELECT (SELECT count(*) FROM acc) AS nodes, (SELECT count(*) FROM acc WHERE label = 1) AS suspicious_nodes,
            (SELECT count(*) FROM acc WHERE label = 0) AS normal_nodes,
            (SELECT round(greatest({', '.join(f'max(abs(({c} - m_{c}) / s_{c}))' for c in ACCOUNT_COLUMNS)}), 6) FROM acc CROSS JOIN
              (SELECT {', '.join(f'avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}' for c in ACCOUNT_COLUMNS)} FROM acc)) AS max_feature_value,
            {len(ACCOUNT_COLUMNS)} AS features, (SELECT bool_or({' OR '.join(f'isnan({c} * 1e0) OR {c} IS NULL' for c in ACCOUNT_COLUMNS)}) FROM acc) AS has_nan,
            (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT customer_id FROM acc GROUP BY 1 HAVING count(*) > 1)) AS multi_account_customers,
            (SELECT count(*) FROM by_customer) AS shared_customer_edges""",
        "neighbor_mean": edges + "SELECT src AS account_id, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in NEIGHBOR_COLUMNS)
            + " FROM edges JOIN acc ON acc.account_id = dst GROUP BY src",
        "accounts_per_customer": txn + """SELECT customer_id, count(DISTINCT account_id) AS accounts,
            array_to_string(list_sort(list(DISTINCT account_id)), ',') AS account_ids FROM t GROUP BY customer_id""",
        "account_dimension": f"WITH {TXN}{LATE} " + """SELECT account_id, arg_min(customer_id, arrival_seq) AS customer_id, arg_min(account_tier, arrival_seq) AS account_tier,
            arg_min(transaction_id, arrival_seq) AS first_transaction FROM late GROUP BY account_id""",
        "suspicious_accounts": txn + "SELECT account_id, 1 AS label FROM t WHERE is_suspicious GROUP BY account_id",
        "structuring_report": feat.rstrip() + f""", c AS (SELECT account_id, customer_id, {six(['amount', 'cross_account_sum_24h', 'cross_account_threshold_ratio'])},
            suspicious_typology AS s, arrival_seq FROM feat WHERE is_suspicious = 1)
            SELECT 'cross_account' AS kind, * EXCLUDE (s, arrival_seq) FROM c WHERE contains(s, 'cross_account')
            UNION ALL (SELECT 'single_account' AS kind, * EXCLUDE (s, arrival_seq) FROM c WHERE contains(s, 'structuring') AND NOT contains(s, 'cross') ORDER BY c.arrival_seq LIMIT 5)""",
        "feature_profile": feat.rstrip() + ", means AS (SELECT account_id, " + ", ".join(f"round(sum(round({c} * 1.0, 6)::DECIMAL(28, 6))::DOUBLE / count({c}), 6) AS {c}" for c in PROFILED) + """
            FROM feat GROUP BY account_id), long AS (UNPIVOT means ON """ + ", ".join(PROFILED) + """ INTO NAME feature VALUE v)
            SELECT feature, count(*) FILTER (isnan(v)) AS nan_values, count(*) FILTER (isinf(v)) AS inf_values, round(min(v), 4) AS min, round(max(v), 4) AS max,
            count(DISTINCT v) AS distinct_values, round(stddev_pop(v), 4) AS std, stddev_pop(v) = 0 AS zero_variance FROM long GROUP BY feature""",
        "label_distribution": txn + """SELECT CAST(is_suspicious AS INT) AS is_suspicious, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct
            FROM t GROUP BY t.is_suspicious""",
        "classification_metrics": fused.rstrip() + Y + f" SELECT *, {RATIOS} FROM (SELECT {METRICS} FROM y)",
        "classification_by_tier": fused.rstrip() + Y + f" SELECT *, {RATIOS} FROM (SELECT account_tier, {METRICS} FROM y GROUP BY account_tier)",
        "average_precision": fused.rstrip() + Y + """, s AS (SELECT risk_score, count(*) AS n, count(*) FILTER (y) AS hits FROM y GROUP BY risk_score),
            c AS (SELECT hits, sum(hits) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (ORDER BY risk_score DESC))
            SELECT round(sum(hits * tp / seen) / sum(hits), 6) AS average_precision FROM c""",
        "anomaly_threshold": txn.rstrip() + """, s AS (SELECT amount / 1e6 AS score, (SELECT avg(CAST(is_suspicious AS INT)) FROM t) AS c FROM t),
            q AS (SELECT list_sort(list(score)) AS v, (1 - max(c)) * (count(*) - 1) AS place FROM s),
            h AS (SELECT v[CAST(floor(place) AS BIGINT) + 1] + (v[CAST(floor(place) AS BIGINT) + 2] - v[CAST(floor(place) AS BIGINT) + 1]) * (place - floor(place)) AS threshold FROM q)
            SELECT round((SELECT threshold FROM h), 6) AS threshold, count(*) FILTER (score >= (SELECT threshold FROM h)) AS flagged FROM s""",
        "temporal_split": txn + """SELECT transaction_id, CASE WHEN row_number() OVER (ORDER BY arrival_seq) <= floor((SELECT count(*) FROM t) * 0.75)
            THEN 'train' ELSE 'test' END AS split FROM t""",
        "node_split": txn.rstrip() + """, a AS (SELECT account_id, min(arrival_seq) AS first_seq FROM t GROUP BY 1) SELECT account_id,
            CASE WHEN row_number() OVER (ORDER BY first_seq) <= floor((SELECT count(*) FROM a) * 0.75) THEN 'train' ELSE 'test' END AS split FROM a""",
        "class_weights": txn.rstrip() + """, c AS (SELECT CAST(is_suspicious AS INT) AS label, count(*) AS n FROM t GROUP BY 1)
            SELECT label, n, round((SELECT count(*) FROM t) / (2.0 * n), 6) AS balanced_weight,
            CASE WHEN label = 0 THEN 1.0 ELSE round(least((SELECT n FROM c WHERE label = 0) / n, 10.0), 6) END AS graph_weight FROM c""",
        "rule_registry": ruled.rstrip() + """, h AS (SELECT unnest(rules) AS rule FROM ruled)
            SELECT reg.rule, severity, length(regulatory_reference) AS reference_length, (SELECT count(*) FROM h WHERE h.rule = reg.rule) AS triggered FROM reg""",
        "score_fusion": fused + "SELECT transaction_id, risk_score, risk_tier FROM f",
        "alerts": ruled + f"SELECT {', '.join(alert_columns)}, timestamp FROM al",
        "alert_regulatory_lookup": ruled + f"SELECT transaction_id, {', '.join(MODEL_ONLY)} FROM al",
        "alert_summary": fused + """SELECT count(*) AS transactions, count(*) FILTER (risk_tier <> 'LOW') AS flagged,
            round(100.0 * count(*) FILTER (risk_tier <> 'LOW') / greatest(count(*), 1), 4) AS flagged_pct,
            count(*) FILTER (risk_tier = 'HIGH') AS high_alerts, count(*) FILTER (risk_tier = 'MEDIUM') AS medium_alerts,
            count(*) FILTER (risk_score >= 40) AS alerts FROM f""",
        "top_alert": fused + "SELECT transaction_id, account_id, customer_id, risk_score, risk_tier FROM f ORDER BY risk_score DESC, arrival_seq LIMIT 1",
        "high_alert_candidates": fused + """SELECT transaction_id, risk_score, risk_tier FROM (SELECT * FROM f ORDER BY arrival_seq DESC LIMIT 500)
            WHERE risk_tier = 'HIGH' AND risk_score >= 85""",
        "customer_snapshot": fused.rstrip() + LATE_FUSED + SNAPSHOT,
        "stream_snapshot": fused.rstrip() + ", g AS (SELECT * FROM f)" + SNAPSHOT,
        "stream_features": feat + f"SELECT {six(full)} FROM feat",
        "stream_flagged": all_rules(PRODUCTION),
        "stream_counters": fused + """SELECT count(*) AS transactions, count(*) FILTER (risk_tier <> 'LOW') AS flagged,
            round(100.0 * count(*) FILTER (risk_tier <> 'LOW') / greatest(count(*), 1), 4) AS flagged_pct,
            count(*) FILTER (risk_tier = 'HIGH') AS high_alerts, count(*) FILTER (risk_tier = 'MEDIUM') AS medium_alerts,
            count(*) FILTER (risk_score >= 40) AS alerts FROM f""",
        "stream_rejected": txn + f"""SELECT arrival_seq, CASE WHEN {LINES_OK} THEN 'accepted' WHEN arrival_seq % 89 = 0 THEN 'malformed' ELSE 'no_customer' END AS status,
            CASE WHEN {LINES_OK} THEN transaction_id END AS transaction_id, CASE WHEN {LINES_OK} THEN customer_id END AS customer_id,
            CASE WHEN {LINES_OK} THEN amount END AS amount FROM t WHERE arrival_seq % 97 <> 0""",
        "recent_history": f"WITH {TXN}{HISTORY} SELECT customer_id, transaction_id, place FROM ranked WHERE place <= 10",
        "history_summary": f"WITH {TXN}{HISTORY} SELECT * FROM history",
        "account_breakdown": txn.rstrip() + """, w AS (SELECT customer_id, account_id FROM t UNION SELECT customer_id, customer_id || '-UNUSED' FROM t), o AS (
            SELECT w.customer_id, w.account_id, count(t.m) AS transactions, CAST(coalesce(sum(t.m), 0) AS BIGINT) AS s FROM w LEFT JOIN t
              ON t.account_id = w.account_id AND t.customer_id = w.customer_id GROUP BY 1, 2)
            SELECT customer_id, account_id, transactions, s / 100.0 AS total, CAST(sum(s) OVER c AS BIGINT) / 100.0 AS combined_total,
            round(CAST(sum(s) OVER c AS BIGINT) / 100.0 / 5000000, 6) AS threshold_multiple FROM o WINDOW c AS (PARTITION BY customer_id)""",
        "alert_history": fused + """SELECT customer_id, transaction_id FROM t WHERE customer_id = (SELECT customer_id FROM f ORDER BY risk_score DESC, arrival_seq LIMIT 1)""",
        "case_report": f"WITH {TXN}{FUSED}{HISTORY}, {NOTES.strip()}" + """, d AS (SELECT count(*) AS n FROM documents),
            a AS (SELECT customer_id, array_to_string(list_sort(list(DISTINCT account_id)), ',') AS all_accounts, count(DISTINCT account_id) AS c FROM t GROUP BY 1)
            SELECT transaction_id, f.customer_id, f.account_id, risk_score, risk_tier, all_accounts, length(summary) AS history_length,
            'pattern' AS pattern_analysis, CASE WHEN c > 1 THEN 'cross' END AS cross_account_analysis, md5(answer) AS assessment_md5,
            CASE WHEN recommendation = 'FILE STR' THEN 'draft' END AS str_draft, recommendation AS final_recommendation, 'PENDING' AS mlro_decision
            FROM f JOIN a USING (customer_id) JOIN history USING (customer_id) CROSS JOIN d JOIN verdicts v ON v.doc_id % d.n = f.arrival_seq % d.n
            WHERE risk_tier = 'HIGH'""",
        "standard_scale": feat.rstrip() + SCALED + " SELECT transaction_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in S.FEATURE_COLUMNS) + " FROM scaled",
        "scaler_reload": feat.rstrip() + SCALED + " SELECT transaction_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in S.FEATURE_COLUMNS) + " FROM scaled",
        "smote": feat.rstrip() + SCALED + SMOTE,
        "sage_forward": edges.rstrip() + sage_forward_sql(),
        "smote_neighbors": feat.rstrip() + SCALED + f""", x AS (SELECT transaction_id, [{', '.join(S.FEATURE_COLUMNS)}]::DOUBLE[] AS v FROM scaled WHERE train AND is_suspicious = 1),
            d AS (SELECT a.transaction_id, list_distance(a.v, b.v) AS distance FROM x a JOIN x b ON a.transaction_id <> b.transaction_id),
            p AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY distance) AS place FROM d)
            SELECT transaction_id, place, round(distance, 6) AS distance FROM p WHERE place <= least(5, (SELECT count(*) FROM x) - 1)""",
        "flagged_transactions": all_rules(PRODUCTION),
        "flagged_wide_profile": all_rules(WIDE),
        "flagged_test_profile": all_rules(TEST, PREDICATES | TEST_PREDICATES),
        "flagged_aligned": all_rules(PRODUCTION, origin="1970-01-05", right=True),
    }
    for key, name in RULE_KEYS.items():
        queries[key] = f"WITH {TXN} {rule_sql(name, WIDE, PREDICATES)}"
    for key, columns in FEATURE_GROUPS.items():
        queries[key] = feat + f"SELECT transaction_id, {six(columns)} FROM feat"
    queries["report_files"] = queries["case_report"]
    return queries
