"""Metamorphic relations between metrics (Σ daily = total, ALL = Σ types) and empty / no-fraud inputs."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import marts, metrics
from ledgerflow.operators.enrich import enrich_transactions
from ledgerflow.sources import fixtures

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def scored(spark):
    df = enrich_transactions(fixtures.transactions(spark, SF_SMALL)).persist()
    yield df
    df.unpersist()


def test_sums_agree(scored):
    total = metrics.summary(scored).first()
    daily = metrics.daily_volume(scored).agg(F.sum("volume")).first()[0]
    hourly = metrics.hourly_volume(scored).agg(F.sum("volume")).first()[0]
    assert round(daily, 2) == round(hourly, 2) == total["total_volume"]
    assert metrics.transactions_by_step(scored).agg(F.sum("transaction_count")).first()[0] == total["total_transactions"]
    by_type = metrics.type_totals_vs_fraud(scored).agg(F.sum("transaction_count"), F.sum("fraud_count")).first()
    assert (by_type[0], by_type[1]) == (total["total_transactions"], total["total_fraud"])
    assert metrics.fraud_by_step(scored).agg(F.sum("fraud_count")).first()[0] == total["total_fraud"]
    amounts = metrics.amount_distribution(scored).agg(F.sum("transaction_count")).first()[0]
    assert amounts == scored.where("amount > 0").count()


def test_mart_all_rows_are_sums_of_types(scored):
    mart = marts.daily_transaction_summary(scored, ordered=False)
    types = mart.where("transaction_type != 'ALL'").groupBy("date").agg(
        F.sum("transaction_count").alias("n"), F.sum("high_risk_count").alias("h"), F.max("unique_senders").alias("u")
    )
    alls = mart.where("transaction_type = 'ALL'").select("date", "transaction_count", "high_risk_count", "unique_senders")
    j = types.join(alls, "date", "full_outer").collect()
    assert all(r["n"] == r["transaction_count"] and r["h"] == r["high_risk_count"] and r["u"] == r["unique_senders"] for r in j)
    assert mart.where("transaction_type = 'ALL'").agg(F.sum("transaction_count")).first()[0] == scored.count()


def test_empty_and_no_fraud_inputs(scored):
    empty = scored.where(F.lit(False))
    m = metrics.fraud_metrics(empty).first()
    assert (m["total_transactions"], m["total_fraud"], m["fraud_rate"]) == (0, 0, 0.0)
    assert m["fraud_amount"] is None and m["transaction_types"] == {}
    no_fraud = scored.where(~F.col("is_fraud"))
    s = metrics.summary(no_fraud).first()
    assert s["total_fraud"] == 0 and s["avg_fraud_amount"] == 0.0 and s["fraud_amount"] == 0.0
    d = metrics.detection_stats(no_fraud).first()
    assert d["detection_rate"] == 0.0
    st = metrics.fraud_amount_stats(no_fraud).first()
    assert st["total_fraud_amount"] == 0.0 and st["avg_fraud_amount"] is None
    a5 = {r["amount_category"]: r["transaction_count"] for r in metrics.amount_distribution(empty).collect()}
    assert a5 == {"small": 0, "medium": 0, "large": 0, "very_large": 0}
