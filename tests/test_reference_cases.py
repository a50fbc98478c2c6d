"""The reference's own hand-made frames and expectations (payments, alerts, risk metrics, quality samples)."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.operators import alerts as AL
from ledgerflow.operators import quality as Q

NOW = datetime(2024, 5, 17, 15, 30, 0)


@pytest.fixture()
def payments(spark):
    rows = [
        (1, 100.50, "USD", "completed", "credit_card", NOW, 1, 1, "user1@test.com", "Amazon", "retail"),
        (2, 2500.00, "USD", "completed", "bank_transfer", NOW - timedelta(hours=1), 2, 2, "user2@test.com", "Netflix", "entertainment"),
        (3, 45.99, "EUR", "failed", "credit_card", NOW - timedelta(hours=2), 1, 3, "user3@test.com", "Amazon", "retail"),
        (4, 1500.00, "USD", "fraudulent", "crypto", NOW - timedelta(hours=3), 3, 4, "user4@test.com", "Unknown", "unknown"),
        (5, 25.00, "GBP", "completed", "digital_wallet", NOW - timedelta(hours=4), 2, 5, "user5@test.com", "Netflix", "entertainment"),
    ]
    return spark.createDataFrame(rows, S.PAYMENT)


@pytest.fixture()
def alerts(spark):
    rows = [
        (1, 1, 0.85, "suspicious_amount", "open", NOW, 100.50, "credit_card"),
        (2, 4, 0.92, "new_merchant", "investigating", NOW - timedelta(hours=1), 1500.00, "crypto"),
        (3, 5, 0.45, "unusual_pattern", "resolved", NOW - timedelta(hours=2), 25.00, "digital_wallet"),
    ]
    return spark.createDataFrame(rows, S.FRAUD_ALERT)


def test_transform_transactions(payments):
    out = AL.transform_payments(payments)
    cols = set(out.columns)
    for c in ["transaction_date", "transaction_hour", "transaction_day_of_week", "status_category",
              "amount_category", "amount_usd", "is_high_value"]:
        assert c in cols
    assert dict(out.dtypes)["transaction_hour"] == "int"
    assert dict(out.dtypes)["is_high_value"] == "boolean"
    rows = {r["id"]: r for r in out.collect()}
    assert {"successful", "failed", "fraudulent"} <= {r["status_category"] for r in rows.values()}
    assert {"small", "large"} <= {r["amount_category"] for r in rows.values()}
    assert rows[3]["amount_usd"] > 45.99 and rows[5]["amount_usd"] > 25.00
    assert rows[1]["amount_usd"] == 100.50


def test_transform_fraud_alerts(alerts):
    out = AL.transform_alerts(alerts)
    for c in ["alert_date", "alert_hour", "risk_category", "alert_priority", "amount_category"]:
        assert c in out.columns
    rows = out.collect()
    assert {"high", "medium", "low"} <= {r["risk_category"] for r in rows}
    assert {"high", "medium", "low"} <= {r["alert_priority"] for r in rows}
    high_risk = [r for r in rows if r["risk_score"] > 0.8][0]
    assert high_risk["alert_priority"] == "high"


def test_calculate_risk_metrics(payments, alerts):
    m = AL.risk_metrics(payments, alerts).first().asDict()
    for k in ["total_transactions", "total_volume", "avg_transaction", "total_fraud_alerts", "fraud_rate",
              "avg_risk_score", "high_value_fraud_rate"]:
        assert k in m
    assert m["total_transactions"] == 5
    assert m["total_fraud_alerts"] == 3
    assert m["fraud_rate"] == 3 / 5
    assert m["avg_risk_score"] > 0
    assert m["high_value_fraud_rate"] == 0.0  # no transaction above 10000
    rates = AL.payment_method_fraud_rate_map(payments, alerts).first()["payment_method_fraud_rates"]
    assert isinstance(rates, dict)
    assert rates["crypto"] == 1.0 and rates["credit_card"] == 0.5 and rates["bank_transfer"] == 0.0


def test_completeness(spark):
    df = spark.createDataFrame(
        [(1, 100.50, "USD", "completed", "credit_card"), (2, None, "EUR", "failed", None),
         (None, 45.99, "USD", "completed", "credit_card"), (4, 1500.00, None, "completed", "bank_transfer")],
        "id long, amount double, currency string, status string, payment_method string",
    )
    got = {r["check_name"]: r["failed_rows"] for r in Q.completeness(df).collect()}
    assert got == {"id_complete": 1, "amount_complete": 1, "currency_complete": 1, "status_complete": 0,
                   "payment_method_complete": 1}


def test_consistency(spark):
    df = spark.createDataFrame([(1, "completed", 100.50), (2, "pending", -50.0), (3, "invalid_status", 0.0)],
                               "id long, status string, amount double")
    got = {r["check_name"]: (r["failed_rows"], r["status"]) for r in Q.run_row_checks(
        df, [Q.allowed_values("status", S.PAYMENT_STATUSES), Q.positive("amount")]).collect()}
    assert got == {"status_allowed": (1, "fail_soft"), "amount_positive": (2, "fail_soft")}


def test_range(spark):
    df = spark.createDataFrame([(1, 0.85, 100.50), (2, 1.5, 0.0), (3, -0.1, 1000000.0)],
                               "id long, risk_score double, amount double")
    got = {r["check_name"]: r["failed_rows"] for r in Q.run_row_checks(
        df, [Q.in_range("risk_score", 0.0, 1.0), Q.at_most("amount", S.UNREASONABLE_AMOUNT, "amount_reasonable")]).collect()}
    assert got == {"risk_score_in_range": 2, "amount_reasonable": 1}


def test_thresholds_and_stored_failures(spark, tmp_dir):
    df = spark.range(0, 1500).select(F.col("id"), (F.col("id") % 3 == 0).alias("bad"),
                                     F.when(F.col("id") < 150, F.lit(None)).otherwise(F.col("id")).alias("v"))
    checks = [Q.RowCheck("many", F.col("bad")), Q.not_null("v"), Q.RowCheck("none", F.lit(False))]
    got = {r["check_name"]: (r["failed_rows"], r["status"]) for r in Q.run_row_checks(df, checks).collect()}
    assert got == {"many": (500, "warn"), "v_not_null": (150, "warn"), "none": (0, "pass")}
    Q.store_failures(df, checks, f"{tmp_dir}/failures")
    stored = spark.read.parquet(f"{tmp_dir}/failures")
    assert {r["check_name"]: r["count"] for r in stored.groupBy("check_name").count().collect()} == {
        "many": 500, "v_not_null": 150}
    big = spark.range(0, 1200).select(F.lit(None).cast("int").alias("v"))
    assert Q.run_row_checks(big, [Q.not_null("v")]).first()["status"] == "error"


def test_unique_and_referential(spark, payments, alerts):
    dup = payments.unionByName(payments.where("id = 2"))
    assert Q.unique_check(dup, ["id"]).first()["failed_rows"] == 1
    orphan = alerts.unionByName(alerts.where("id = 1").withColumn("transaction_id", F.lit(99).cast("long")))
    assert Q.referential_check(orphan, "transaction_id", payments, "id").first()["failed_rows"] == 1
    assert AL.orphan_alerts(orphan, payments).count() == 1
