"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs in DuckDB against the test tables registered as views. The fixture projections of
FIXTURES.md part B appear once, as CTE text, and are shared by every query.
"""

from __future__ import annotations

# --- fixture CTEs ------------------------------------------------------------------------------

TXN = """
txn AS (
  SELECT
    CAST(date_diff('day', DATE '1995-01-01', CAST(l.l_shipdate AS DATE)) * 24 + (l.l_orderkey % 24) AS INTEGER) AS time_step,
    CASE o.o_orderpriority
      WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT' WHEN '3-MEDIUM' THEN 'PAYMENT'
      WHEN '4-NOT SPECIFIED' THEN 'CASH_IN' WHEN '5-LOW' THEN 'DEBIT' END AS transaction_type,
    CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) * 2 AS DECIMAL(18,2)) AS amount,
    'C' || CAST(o.o_custkey AS VARCHAR) AS sender_id,
    CAST(c.c_acctbal AS DECIMAL(18,2)) AS sender_old_balance,
    CAST(CAST(c.c_acctbal AS DECIMAL(18,2))
         - CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) * 2 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS sender_new_balance,
    'M' || CAST(l.l_suppkey AS VARCHAR) AS receiver_id,
    CAST(s.s_acctbal AS DECIMAL(18,2)) AS receiver_old_balance,
    CAST(CAST(s.s_acctbal AS DECIMAL(18,2))
         + CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) * 2 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS receiver_new_balance,
    (l.l_returnflag = 'R' AND l.l_quantity <= 2) AS is_fraud,
    (l.l_returnflag = 'R' AND l.l_quantity <= 1) AS is_flagged_fraud
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

P95 = """
p95 AS (SELECT quantile_cont(CAST(amount AS DOUBLE), 0.95) AS p95 FROM txn)"""

ENRICHED = """
enriched0 AS (
  SELECT t.*,
    TIMESTAMP '2017-01-01 00:00:00' + to_hours(t.time_step) AS transaction_date,
    CAST(((t.time_step % 24) + 24) % 24 AS INTEGER) AS transaction_hour,
    CAST(floor(t.time_step / 24.0) AS INTEGER) AS transaction_day,
    CASE WHEN t.amount IS NULL OR t.amount <= 0 THEN NULL WHEN t.amount <= 100 THEN 'small'
         WHEN t.amount <= 1000 THEN 'medium' WHEN t.amount <= 10000 THEN 'large' ELSE 'very_large' END AS amount_category,
    coalesce(t.amount > 10000, false) AS high_value_transaction,
    coalesce(CAST(t.amount AS DOUBLE) > p95.p95, false) AS unusual_amount,
    CASE WHEN CAST(t.sender_old_balance AS DOUBLE) + 1.0 = 0
         THEN CASE WHEN abs(CAST(t.sender_new_balance AS DOUBLE) - CAST(t.sender_old_balance AS DOUBLE)) = 0
                   THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END
         ELSE abs(CAST(t.sender_new_balance AS DOUBLE) - CAST(t.sender_old_balance AS DOUBLE))
              / (CAST(t.sender_old_balance AS DOUBLE) + 1.0) END AS balance_change_ratio
  FROM txn t CROSS JOIN p95
),
enriched AS (
  SELECT *,
    (CASE WHEN coalesce(is_fraud, false) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN high_value_transaction THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN unusual_amount THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN balance_change_ratio > 0.5 AND NOT isnan(balance_change_ratio) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)
    AS risk_score
  FROM enriched0
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


SCORED = (TXN, P95, ENRICHED)

# --- queries -----------------------------------------------------------------------------------

DAILY_PARTIALS = """
partials AS (
  SELECT CAST(transaction_date AS DATE) AS date, transaction_type,
    COUNT(*) AS transaction_count,
    SUM(amount) AS _volume, COUNT(amount) AS _amount_n,
    SUM(CAST(risk_score AS DECIMAL(20,4))) AS _risk_sum, COUNT(risk_score) AS _risk_n,
    COUNT(*) FILTER (WHERE risk_score > 0.7) AS high_risk_count,
    COUNT(*) FILTER (WHERE risk_score > 0.9) AS critical_risk_count,
    COUNT(DISTINCT sender_id) AS unique_senders,
    COUNT(DISTINCT receiver_id) AS unique_receivers
  FROM enriched GROUP BY 1, 2
)"""

DAILY_MART = with_ctes(
    *SCORED,
    DAILY_PARTIALS,
    body="""
SELECT date, transaction_type, transaction_count,
  CAST(_volume AS DOUBLE) AS total_volume,
  CAST(_volume AS DOUBLE) / NULLIF(_amount_n, 0) AS avg_amount,
  CAST(_risk_sum AS DOUBLE) / NULLIF(_risk_n, 0) AS avg_risk_score,
  high_risk_count, critical_risk_count, unique_senders, unique_receivers
FROM partials
UNION ALL
SELECT date, 'ALL', CAST(SUM(transaction_count) AS BIGINT),
  CAST(SUM(_volume) AS DOUBLE),
  CAST(SUM(_volume) AS DOUBLE) / NULLIF(SUM(transaction_count), 0),
  CAST(SUM(_risk_sum) AS DOUBLE) / NULLIF(SUM(_risk_n), 0),
  CAST(SUM(high_risk_count) AS BIGINT), CAST(SUM(critical_risk_count) AS BIGINT),
  MAX(unique_senders), MAX(unique_receivers)
FROM partials GROUP BY date
ORDER BY 1, 2""",
)

ORACLE: dict[str, str] = {
    "a20_daily_transaction_summary": DAILY_MART,
}

# --- transaction features and metrics (P, A) -----------------------------------------------------

SCORED_COLUMNS = """
  time_step, transaction_type, CAST(amount AS DOUBLE) AS amount, sender_id,
  CAST(sender_old_balance AS DOUBLE) AS sender_old_balance, CAST(sender_new_balance AS DOUBLE) AS sender_new_balance,
  receiver_id, CAST(receiver_old_balance AS DOUBLE) AS receiver_old_balance,
  CAST(receiver_new_balance AS DOUBLE) AS receiver_new_balance, is_fraud, is_flagged_fraud,
  transaction_date, transaction_hour, transaction_day, amount_category, high_value_transaction,
  unusual_amount, balance_change_ratio, risk_score"""


def _scored(body: str, *extra: str) -> str:
    return with_ctes(*SCORED, *extra, body=body)


def _type_counts(where: str) -> str:
    return (
        "coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT transaction_type || ':' || CAST(COUNT(*) AS VARCHAR) AS k "
        f"FROM enriched WHERE transaction_type IS NOT NULL {where} GROUP BY transaction_type)), '')"
    )


ORACLE.update(
    {
        "p9_scored_transactions": _scored(f"SELECT {SCORED_COLUMNS} FROM enriched"),
        "p15_processed_transactions": _scored(
            f"""SELECT {SCORED_COLUMNS},
              CAST(amount AS DOUBLE) * 1.1::DOUBLE AS amount_usd,
              CASE WHEN risk_score IS NULL OR isnan(risk_score) OR risk_score <= 0 THEN NULL
                   WHEN risk_score <= 0.3 THEN 'low' WHEN risk_score <= 0.7 THEN 'medium'
                   WHEN risk_score <= 1.0 THEN 'high' ELSE NULL END AS risk_category,
              transaction_hour AS hour_of_day,
              dayname(transaction_date) AS day_of_week,
              coalesce(time_step IS NOT NULL AND transaction_type IS NOT NULL AND amount IS NOT NULL
                       AND sender_id IS NOT NULL AND receiver_id IS NOT NULL AND amount > 0, false) AS is_valid
            FROM enriched"""
        ),
        "p16_staging_flags": _scored(
            """SELECT time_step, transaction_type, sender_id, receiver_id, transaction_date,
                 amount IS NULL AS is_amount_null,
                 coalesce(risk_score < 0 OR risk_score > 1, false) AS is_risk_score_invalid,
                 transaction_date IS NULL AS is_transaction_date_null
               FROM enriched"""
        ),
        "a1_fraud_metrics": _scored(
            f"""SELECT CAST(COUNT(*) AS BIGINT) AS total_transactions,
                 CAST(COUNT(*) FILTER (WHERE is_fraud) AS BIGINT) AS total_fraud,
                 coalesce(CAST(COUNT(*) FILTER (WHERE is_fraud) AS DOUBLE) / NULLIF(COUNT(*), 0), 0.0) AS fraud_rate,
                 {_type_counts('')} AS transaction_types,
                 {_type_counts('AND is_fraud')} AS fraud_by_type,
                 CAST(SUM(amount) AS DOUBLE) / NULLIF(COUNT(amount), 0) AS avg_amount,
                 CAST(SUM(amount) FILTER (WHERE is_fraud) AS DOUBLE) / NULLIF(COUNT(amount) FILTER (WHERE is_fraud), 0) AS fraud_amount,
                 CAST(SUM(CAST(risk_score AS DECIMAL(20,4))) AS DOUBLE) / NULLIF(COUNT(risk_score), 0) AS avg_risk_score,
                 CAST(COUNT(*) FILTER (WHERE risk_score > 0.5 AND NOT isnan(risk_score)) AS BIGINT) AS high_risk_transactions
               FROM enriched"""
        ),
        "a2_summary": _scored(
            """SELECT COUNT(*) AS total_transactions, COUNT(*) FILTER (WHERE is_fraud) AS total_fraud,
                 round_even(coalesce(CAST(COUNT(*) FILTER (WHERE is_fraud) AS DOUBLE) / NULLIF(COUNT(*), 0), 0.0) * 100, 2) AS fraud_rate,
                 round_even(coalesce(CAST(SUM(amount) AS DOUBLE), 0.0), 2) AS total_volume,
                 round_even(CAST(SUM(amount) AS DOUBLE) / NULLIF(COUNT(amount), 0), 2) AS avg_amount,
                 round_even(coalesce(CAST(SUM(amount) FILTER (WHERE is_fraud) AS DOUBLE), 0.0), 2) AS fraud_amount,
                 round_even(CASE WHEN COUNT(*) FILTER (WHERE is_fraud) > 0
                      THEN CAST(SUM(amount) FILTER (WHERE is_fraud) AS DOUBLE) / NULLIF(COUNT(amount) FILTER (WHERE is_fraud), 0)
                      ELSE 0.0 END, 2) AS avg_fraud_amount
               FROM enriched"""
        ),
        "a3_transactions_by_step": _scored(
            "SELECT time_step, COUNT(*) AS transaction_count FROM enriched GROUP BY time_step"
        ),
        "a4_type_distribution": _scored(
            """SELECT transaction_type, COUNT(*) AS transaction_count FROM enriched
               WHERE transaction_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1"""
        ),
        "a5_amount_distribution": _scored(
            """SELECT l.amount_category, CAST(coalesce(c.n, 0) AS BIGINT) AS transaction_count
               FROM (VALUES ('small', 0), ('medium', 1), ('large', 2), ('very_large', 3)) l(amount_category, rnk)
               LEFT JOIN (SELECT amount_category, COUNT(*) AS n FROM enriched WHERE amount_category IS NOT NULL GROUP BY 1) c
               ON l.amount_category = c.amount_category
               ORDER BY 2 DESC, l.rnk"""
        ),
        "a6_fraud_by_type": _scored(
            """SELECT transaction_type, COUNT(*) AS fraud_count FROM enriched
               WHERE is_fraud AND transaction_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1"""
        ),
        "a7_fraud_amount_stats": _scored(
            """SELECT coalesce(CAST(SUM(amount) FILTER (WHERE is_fraud) AS DOUBLE), 0.0) AS total_fraud_amount,
                 CAST(SUM(amount) FILTER (WHERE is_fraud) AS DOUBLE) / NULLIF(COUNT(amount) FILTER (WHERE is_fraud), 0) AS avg_fraud_amount,
                 CAST(MAX(amount) FILTER (WHERE is_fraud) AS DOUBLE) AS max_fraud_amount,
                 CAST(MIN(amount) FILTER (WHERE is_fraud) AS DOUBLE) AS min_fraud_amount
               FROM enriched"""
        ),
        "a8_fraud_by_step": _scored(
            "SELECT time_step, COUNT(*) AS fraud_count FROM enriched WHERE is_fraud GROUP BY time_step"
        ),
        "a9_detection_stats": _scored(
            """SELECT COUNT(*) FILTER (WHERE is_fraud) AS total_fraud,
                 COUNT(*) FILTER (WHERE is_flagged_fraud) AS flagged_fraud,
                 CASE WHEN COUNT(*) FILTER (WHERE is_fraud) > 0
                      THEN COUNT(*) FILTER (WHERE is_flagged_fraud) / COUNT(*) FILTER (WHERE is_fraud)
                      ELSE 0.0 END AS detection_rate
               FROM enriched"""
        ),
        "a11_hourly_volume": _scored(
            """SELECT CAST(((time_step % 24) + 24) % 24 AS INTEGER) AS hour, CAST(SUM(amount) AS DOUBLE) AS volume
               FROM enriched GROUP BY 1"""
        ),
        "a12_daily_volume": _scored(
            """SELECT CAST(floor(time_step / 24.0) AS INTEGER) AS day, CAST(SUM(amount) AS DOUBLE) AS volume
               FROM enriched GROUP BY 1"""
        ),
        "a13_dashboard_metrics": _scored(
            """SELECT COUNT(*) AS total_transactions, COUNT(*) FILTER (WHERE is_fraud) AS total_fraud,
                 CAST(COUNT(*) FILTER (WHERE is_fraud) AS DOUBLE) / NULLIF(COUNT(*), 0) * 100.0::DOUBLE AS fraud_rate,
                 CAST(SUM(amount) AS DOUBLE) AS total_volume,
                 CAST(SUM(amount) AS DOUBLE) / NULLIF(COUNT(amount), 0) AS avg_amount,
                 COUNT(*) FILTER (WHERE amount > 10000) AS high_value_transactions,
                 COUNT(*) FILTER (WHERE CAST(amount AS DOUBLE) > (SELECT p95 FROM p95)) AS unusual_patterns,
                 COUNT(*) FILTER (WHERE balance_change_ratio > 0.5 AND NOT isnan(balance_change_ratio)) AS balance_changes,
                 COUNT(*) FILTER (WHERE is_fraud) + COUNT(*) FILTER (WHERE amount > 10000)
                   + COUNT(*) FILTER (WHERE CAST(amount AS DOUBLE) > (SELECT p95 FROM p95)) AS high_risk_transactions
               FROM enriched"""
        ),
        "a15_percentile_lines": with_ctes(
            TXN,
            body="""SELECT quantile_cont(CAST(amount AS DOUBLE), 0.95) AS p95,
                      quantile_cont(CAST(amount AS DOUBLE), 0.99) AS p99 FROM txn""",
        ),
        "a16_type_totals_vs_fraud": _scored(
            """SELECT transaction_type, COUNT(*) AS transaction_count, COUNT(*) FILTER (WHERE is_fraud) AS fraud_count
               FROM enriched GROUP BY 1"""
        ),
        "a17_daily_report": _scored(
            """SELECT DATE '2018-06-15' AS date, COUNT(*) AS total_transactions,
                 coalesce(CAST(SUM(amount) AS DOUBLE), 0.0) AS total_volume,
                 coalesce(CAST(SUM(CAST(risk_score AS DECIMAL(20,4))) AS DOUBLE) / NULLIF(COUNT(risk_score), 0), 0.0) AS avg_risk_score,
                 COUNT(*) FILTER (WHERE risk_score > 0.7) AS high_risk_count
               FROM enriched
               WHERE transaction_date >= TIMESTAMP '2018-06-15 00:00:00' AND transaction_date < TIMESTAMP '2018-06-16 00:00:00'"""
        ),
        "a23_null_counts": _scored(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM enriched"
                for c in [
                    "time_step", "transaction_type", "amount", "sender_id", "sender_old_balance",
                    "sender_new_balance", "receiver_id", "receiver_old_balance", "receiver_new_balance",
                    "is_fraud", "is_flagged_fraud", "transaction_date", "transaction_hour", "transaction_day",
                    "amount_category", "high_value_transaction", "unusual_amount", "balance_change_ratio", "risk_score",
                ]
            )
        ),
    }
)

# --- payment / alert layouts (B3) -----------------------------------------------------------------

PAYMENTS = """
payments AS (
  SELECT event_id AS id, CAST(CAST(value AS DECIMAL(18,2)) * 50 AS DOUBLE) AS amount,
    ['USD', 'EUR', 'GBP'][event_id % 3 + 1] AS currency,
    ['completed', 'pending', 'failed', 'fraudulent', 'cancelled', 'invalid_status'][event_id % 6 + 1] AS status,
    event_type AS payment_method, ts AS created_at, user_id
  FROM events
)"""

ALERTS = """
alerts AS (
  SELECT event_id AS id,
    event_id + CASE WHEN event_id % 70 = 0 THEN 1000000 ELSE 0 END AS transaction_id,
    least(value / 250.0::DOUBLE, 1.0::DOUBLE) AS risk_score,
    ['suspicious_amount', 'new_merchant', 'unusual_pattern', 'high_risk_location', 'velocity_check', 'device_mismatch'][event_id % 6 + 1] AS alert_type,
    ['open', 'investigating', 'resolved', 'false_positive', 'confirmed_fraud'][event_id % 5 + 1] AS status,
    ts AS created_at, CAST(CAST(value AS DECIMAL(18,2)) * 50 AS DOUBLE) AS amount, event_type AS payment_method
  FROM events
)"""

AMOUNT_CATEGORY_SQL = """CASE WHEN amount IS NULL OR amount <= 0 THEN NULL WHEN amount <= 100 THEN 'small'
  WHEN amount <= 1000 THEN 'medium' WHEN amount <= 10000 THEN 'large' ELSE 'very_large' END"""

VELOCITY = """
velocity AS (
  SELECT *, COUNT(*) OVER (PARTITION BY sender_id ORDER BY time_step RANGE BETWEEN 24 PRECEDING AND CURRENT ROW) AS sender_velocity,
    time_step = MIN(time_step) OVER (PARTITION BY sender_id, receiver_id) AS first_to_receiver
  FROM enriched
)"""

FIRED = """
fired AS (
  SELECT *, unnest(list_filter([
    CASE WHEN unusual_amount THEN 'suspicious_amount' END,
    CASE WHEN balance_change_ratio > 0.5 AND NOT isnan(balance_change_ratio) AND risk_score > 0.5 THEN 'unusual_pattern' END,
    CASE WHEN sender_velocity >= 3 THEN 'velocity_check' END,
    CASE WHEN first_to_receiver AND high_value_transaction THEN 'new_merchant' END], lambda x: x IS NOT NULL)) AS alert_type,
    CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(time_step AS VARCHAR), ''), coalesce(transaction_type, ''), coalesce(CAST(amount AS VARCHAR), ''),
      coalesce(sender_id, ''), coalesce(receiver_id, ''), coalesce(CAST(sender_old_balance AS VARCHAR), ''), coalesce(CAST(receiver_old_balance AS VARCHAR), ''))), 1, 15) AS BIGINT) AS transaction_id
  FROM velocity
)"""

OWN_ALERTS = """
own_alerts AS (
  SELECT CAST('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || '|' || alert_type), 1, 15) AS BIGINT) AS id, transaction_id, alert_type, 'open' AS status,
    risk_score, CAST(amount AS DOUBLE) AS amount, transaction_type AS payment_method,
    alert_type || ': ' || coalesce(transaction_type, 'unknown') || ' of ' || coalesce(CAST(amount AS VARCHAR), 'unknown') || ' from ' || coalesce(sender_id, 'unknown')
      || ' to ' || coalesce(receiver_id, 'unknown') AS description, transaction_date AS created_at
  FROM fired
)"""

ORACLE.update(
    {
        "p21_p25_payment_features": with_ctes(
            PAYMENTS,
            body=f"""SELECT p.id, p.amount, p.currency, p.status, p.payment_method, p.created_at, p.user_id,
                  CAST(p.created_at AS DATE) AS transaction_date, CAST(hour(p.created_at) AS INTEGER) AS transaction_hour,
                  dayname(p.created_at) AS transaction_day_of_week,
                  CASE p.status WHEN 'completed' THEN 'successful' WHEN 'failed' THEN 'failed'
                       WHEN 'fraudulent' THEN 'fraudulent' ELSE 'other' END AS status_category,
                  {AMOUNT_CATEGORY_SQL} AS amount_category,
                  p.amount * r.usd_rate AS amount_usd,
                  coalesce(p.amount > 10000, false) AS is_high_value
                FROM payments p
                LEFT JOIN (VALUES ('EUR', 1.1::DOUBLE), ('GBP', 1.3::DOUBLE), ('USD', 1.0::DOUBLE)) r(currency, usd_rate)
                ON p.currency = r.currency""",
        ),
        "p26_p28_alert_features": with_ctes(
            ALERTS,
            body=f"""SELECT *, CAST(created_at AS DATE) AS alert_date, CAST(hour(created_at) AS INTEGER) AS alert_hour,
                  CASE WHEN risk_score IS NULL OR isnan(risk_score) THEN NULL WHEN risk_score <= 0.5 THEN 'low'
                       WHEN risk_score <= 0.9 THEN 'medium' ELSE 'high' END AS risk_category,
                  CASE status WHEN 'open' THEN 'high' WHEN 'investigating' THEN 'medium' ELSE 'low' END AS alert_priority,
                  {AMOUNT_CATEGORY_SQL} AS amount_category
                FROM alerts""",
        ),
        "a21_risk_metrics": with_ctes(
            PAYMENTS,
            ALERTS,
            body="""SELECT t.total_transactions, coalesce(CAST(t.vol AS DOUBLE), 0.0) AS total_volume,
                  CAST(t.vol AS DOUBLE) / NULLIF(t.n_amount, 0) AS avg_transaction,
                  a.total_fraud_alerts,
                  coalesce(CAST(a.total_fraud_alerts AS DOUBLE) / NULLIF(t.total_transactions, 0), 0.0) AS fraud_rate,
                  CAST(a.risk_sum AS DOUBLE) / NULLIF(a.risk_n, 0) AS avg_risk_score,
                  coalesce(CAST(a.hv AS DOUBLE) / NULLIF(t.hv, 0), 0.0) AS high_value_fraud_rate
                FROM (SELECT COUNT(*) AS total_transactions, SUM(CAST(amount AS DECIMAL(24,6))) AS vol,
                             COUNT(amount) AS n_amount, COUNT(*) FILTER (WHERE amount > 10000) AS hv FROM payments) t,
                     (SELECT COUNT(*) AS total_fraud_alerts, SUM(CAST(risk_score AS DECIMAL(20,6))) AS risk_sum,
                             COUNT(risk_score) AS risk_n, COUNT(*) FILTER (WHERE amount > 10000) AS hv FROM alerts) a""",
        ),
        "a22_payment_method_fraud_rates": with_ctes(
            PAYMENTS,
            ALERTS,
            body="""SELECT t.payment_method, t.transactions, coalesce(a.alerts, 0) AS alerts,
                  coalesce(a.alerts, 0) / t.transactions AS fraud_rate
                FROM (SELECT payment_method, COUNT(*) AS transactions FROM payments GROUP BY 1) t
                LEFT JOIN (SELECT payment_method, COUNT(*) AS alerts FROM alerts GROUP BY 1) a
                ON t.payment_method = a.payment_method""",
        ),
        "j1_alerts_with_transaction": with_ctes(
            PAYMENTS,
            ALERTS,
            body="""SELECT a.*, p.id AS tx_id, p.amount AS tx_amount, p.currency AS tx_currency, p.status AS tx_status,
                  p.payment_method AS tx_payment_method, p.created_at AS tx_created_at, p.user_id AS tx_user_id
                FROM alerts a LEFT JOIN payments p ON a.transaction_id = p.id""",
        ),
        "j2_orphan_alerts": with_ctes(
            PAYMENTS,
            ALERTS,
            body="SELECT a.* FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM payments p WHERE p.id = a.transaction_id)",
        ),
        "j5_patched_alerts": with_ctes(
            ALERTS,
            body="""SELECT a.id, a.transaction_id, coalesce(p.risk_score, a.risk_score) AS risk_score, a.alert_type,
                  coalesce(p.status, a.status) AS status, a.created_at, coalesce(p.amount, a.amount) AS amount, a.payment_method
                FROM alerts a LEFT JOIN (
                  SELECT id, 'resolved' AS status, CAST(NULL AS DOUBLE) AS risk_score,
                         CASE WHEN id % 28 = 0 THEN amount * 2 END AS amount
                  FROM alerts WHERE id % 14 = 0) p ON a.id = p.id""",
        ),
        "o3_alert_page": with_ctes(
            ALERTS,
            body="""SELECT a.*, (SELECT COUNT(*) FROM alerts) AS total, 3 AS page, 50 AS size
                FROM alerts a ORDER BY id LIMIT 50 OFFSET 100""",
        ),
        "w3_velocity": _scored(
            """SELECT time_step, sender_id, receiver_id, sender_velocity, sender_velocity >= 3 AS velocity_check
               FROM velocity""",
            VELOCITY,
        ),
        "w4_first_payment": _scored(
            "SELECT time_step, sender_id, receiver_id, first_to_receiver FROM velocity", VELOCITY
        ),
        "f1_generated_alerts": _scored(
            """SELECT time_step, sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, risk_score, alert_type, 'open' AS status FROM fired""",
            VELOCITY,
            FIRED,
        ),
        "f1_alert_table": _scored("SELECT * FROM own_alerts", VELOCITY, FIRED, OWN_ALERTS),
    }
)

# --- data quality (Q1-Q9) ------------------------------------------------------------------------


def _checks(table: str, checks: list[tuple[str, str]], extra: list[str] = ()) -> str:
    parts = [f"SELECT '{n}' AS check_name, COUNT(*) FILTER (WHERE coalesce({p}, false)) AS failed_rows FROM {table}" for n, p in checks]
    parts += list(extra)
    return f"""SELECT check_name, failed_rows,
      CASE WHEN failed_rows = 0 THEN 'pass' WHEN failed_rows > 1000 THEN 'error'
           WHEN failed_rows > 100 THEN 'warn' ELSE 'fail_soft' END AS status
    FROM ({' UNION ALL '.join(parts)})"""


_ALERT_CHECKS = [
    ("check_risk_scores_in_range", "risk_score < 0 OR risk_score > 1"),
    ("check_alert_type_allowed", "alert_type NOT IN ('suspicious_amount', 'new_merchant', 'unusual_pattern', 'high_risk_location', 'velocity_check', 'device_mismatch')"),
    ("check_alert_status_allowed", "status NOT IN ('open', 'investigating', 'resolved', 'false_positive', 'confirmed_fraud')"),
    ("check_transaction_id_not_null", "transaction_id IS NULL"),
]
_ORPHANS = "SELECT 'check_alert_transaction_exists', COUNT(*)"

ORACLE.update(
    {
        "q_transaction_checks": _scored(
            _checks(
                "enriched",
                [
                    ("check_transaction_amounts_not_null", "amount IS NULL"),
                    ("check_risk_scores_in_range", "risk_score < 0 OR risk_score > 1"),
                    ("check_timestamp_format", "transaction_date IS NULL"),
                    ("check_merchant_names_not_empty", "receiver_id IS NULL OR trim(receiver_id) = ''"),
                    ("check_amount_within_bounds", "amount < 0.01 OR amount > 1000000"),
                    ("check_amount_positive", "amount <= 0"),
                    ("check_amount_reasonable", "amount > 100000"),
                    ("check_sender_id_not_null", "sender_id IS NULL"),
                ],
                [
                    "SELECT 'check_transaction_key_unique', COUNT(*) FROM (SELECT time_step, sender_id, receiver_id "
                    "FROM enriched WHERE time_step IS NOT NULL AND sender_id IS NOT NULL AND receiver_id IS NOT NULL GROUP BY ALL HAVING COUNT(*) > 1)"
                ],
            )
        ),
        "q_payment_checks": with_ctes(
            PAYMENTS,
            body=_checks(
                "payments",
                [
                    ("check_status_allowed", "status NOT IN ('completed', 'pending', 'failed', 'fraudulent', 'cancelled')"),
                    ("check_amount_positive", "amount <= 0"),
                    ("check_amount_reasonable", "amount > 100000"),
                    ("check_id_not_null", "id IS NULL"),
                    ("check_currency_not_null", "currency IS NULL"),
                    ("check_payment_method_not_null", "payment_method IS NULL"),
                ],
                ["SELECT 'check_id_unique', COUNT(*) FROM (SELECT id FROM payments WHERE id IS NOT NULL GROUP BY id HAVING COUNT(*) > 1)"],
            ),
        ),
        "q_alert_checks": with_ctes(
            PAYMENTS, ALERTS, body=_checks("alerts", _ALERT_CHECKS, [_ORPHANS + " FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM payments p WHERE p.id = a.transaction_id)"])
        ),
        "f1_alert_checks": _scored(_checks("own_alerts", _ALERT_CHECKS, [_ORPHANS + " FROM own_alerts WHERE false"]), VELOCITY, FIRED, OWN_ALERTS),
        "q7_payment_completeness": with_ctes(
            PAYMENTS,
            body=_checks(
                "payments",
                [(f"{c}_complete", f"{c} IS NULL") for c in ["id", "amount", "currency", "status", "payment_method", "created_at", "user_id"]],
            ),
        ),
    }
)

# --- stream batch twins (T2-T8, W1, W2, J4) ---------------------------------------------------------

MESSAGES = """
msgs AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || json_extract_string(props, '$.k') AS message_key,
    event_id AS "offset", 'transactions' AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", ts AS message_timestamp,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 AS INTEGER) AS time_step,
    event_type AS transaction_type, CAST(value AS DECIMAL(18,2)) AS amount,
    'C' || CAST(user_id AS VARCHAR) AS sender_id, 'M' || event_type AS receiver_id,
    CASE WHEN event_id % 50 = 0 THEN 'invalid' WHEN event_id % 50 = 1 THEN 'error' ELSE 'ok' END AS status0
  FROM events
),
firsts AS (SELECT message_key, MIN("offset") AS first_ok FROM msgs WHERE status0 = 'ok' GROUP BY 1),
final AS (
  SELECT m.*, CASE WHEN f.first_ok IS NULL THEN m.status0 WHEN m."offset" = f.first_ok THEN 'success'
                   WHEN m."offset" > f.first_ok THEN 'duplicate' ELSE m.status0 END AS status
  FROM msgs m LEFT JOIN firsts f ON m.message_key = f.message_key
)"""

ORACLE.update(
    {
        "t3_t4_message_status": with_ctes(
            MESSAGES, body='SELECT message_key, "offset", "partition", status FROM final'
        ),
        "t6_status_counts": with_ctes(
            MESSAGES,
            body="""SELECT s.status, CAST(coalesce(c.n, 0) AS BIGINT) AS messages
                FROM (VALUES ('success'), ('duplicate'), ('invalid'), ('error')) s(status)
                LEFT JOIN (SELECT status, COUNT(*) AS n FROM final GROUP BY 1) c ON s.status = c.status""",
        ),
        "j4_upserted_transactions": with_ctes(
            MESSAGES,
            body="""SELECT time_step, sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, transaction_type,
                  0.0::DOUBLE AS sender_old_balance, 0.0::DOUBLE AS sender_new_balance,
                  0.0::DOUBLE AS receiver_old_balance, 0.0::DOUBLE AS receiver_new_balance,
                  false AS is_fraud, false AS is_flagged_fraud, 0.0::DOUBLE AS risk_score
                FROM (SELECT *, row_number() OVER (PARTITION BY time_step, sender_id, receiver_id ORDER BY "offset" DESC) AS rn
                      FROM final WHERE status = 'success') WHERE rn = 1""",
        ),
        "t7_consumer_lag": with_ctes(
            MESSAGES,
            body="""SELECT e.topic, e."partition", e.end_offset - coalesce(d.last_offset, 0) AS lag
                FROM (SELECT topic, "partition", MAX("offset") + 1 AS end_offset FROM msgs GROUP BY 1, 2) e
                LEFT JOIN (SELECT topic, "partition", MAX("offset") AS last_offset FROM final
                           WHERE status = 'success' GROUP BY 1, 2) d
                ON e.topic = d.topic AND e."partition" = d."partition" """,
        ),
        "t8_delay_histogram": with_ctes(
            MESSAGES,
            body="""SELECT le, count FROM (
                  SELECT b.le, COUNT(*) FILTER (WHERE
                    epoch(message_timestamp) - epoch(TIMESTAMP '2024-01-01 00:00:00' + to_hours(time_step)) <= b.le) AS count
                  FROM msgs CROSS JOIN (VALUES (60.0::DOUBLE), (600.0::DOUBLE), (3600.0::DOUBLE), (21600.0::DOUBLE), (86400.0::DOUBLE)) b(le)
                  GROUP BY b.le)""",
        ),
    }
)

ORACLE.update(
    {
        "p17_fraud_rows": _scored(
            "SELECT time_step, sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, risk_score FROM enriched WHERE is_fraud"
        ),
        "p18_flagged_rows": _scored(
            "SELECT time_step, sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, is_fraud FROM enriched WHERE is_flagged_fraud"
        ),
        "p19_rows_of_day": _scored(
            """SELECT time_step, transaction_type, sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, transaction_date
               FROM enriched WHERE CAST(transaction_date AS DATE) = DATE '2019-03-01'"""
        ),
        "p32_hover_labels": with_ctes(
            TXN,
            body="""SELECT time_step, sender_id, receiver_id,
                  transaction_type || '<br>Amount: $' || CAST(amount AS VARCHAR) AS label FROM txn""",
        ),
        "s2_head_rows": with_ctes(
            TXN,
            body="""SELECT time_step, transaction_type, CAST(amount AS DOUBLE) AS amount, sender_id,
                  CAST(sender_old_balance AS DOUBLE) AS sender_old_balance, CAST(sender_new_balance AS DOUBLE) AS sender_new_balance,
                  receiver_id, CAST(receiver_old_balance AS DOUBLE) AS receiver_old_balance,
                  CAST(receiver_new_balance AS DOUBLE) AS receiver_new_balance, is_fraud, is_flagged_fraud
                FROM txn ORDER BY time_step, sender_id, receiver_id LIMIT 10000""",
        ),
        "w2_latest_message_per_key": with_ctes(
            MESSAGES,
            body="""SELECT time_step, sender_id, receiver_id, "offset", status0 AS status FROM (
                  SELECT *, row_number() OVER (PARTITION BY time_step, sender_id, receiver_id ORDER BY "offset" DESC) AS rn
                  FROM msgs) WHERE rn = 1""",
        ),
    }
)

# The events' fields, read back from their JSON
ORACLE["t9_alert_events"] = with_ctes(
    ALERTS,
    body="""SELECT CAST(id AS VARCHAR) AS key, 'fintech-fraud-alerts' AS topic, 'fraud_alert_created' AS event_type,
          strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, id, transaction_id, risk_score, alert_type, status, amount, payment_method
        FROM alerts""",
)
