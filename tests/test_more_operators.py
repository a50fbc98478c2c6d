"""Operators without a registered query: materialize, append with validation, the analytics bundle,
raw/canonical column resolution, paging errors, lag and histogram helpers, the approximate percentile."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions.features import col_or, hover_label, round_half_even
from ledgerflow.operators import alerts as AL
from ledgerflow.operators import metrics
from ledgerflow.operators.enrich import enrich_transactions
from ledgerflow.sources import files, fixtures
from ledgerflow.streaming import consumer

from conftest import SF_SMALL


def test_materialize_view_and_table(spark, tmp_dir):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    v = files.materialize(df, "stg_numbers", "view")
    assert spark.table("stg_numbers").count() == 5 and v.count() == 5
    t = files.materialize(df.where("id > 1"), "mart_numbers", "table", path=f"{tmp_dir}/mart")
    assert t.count() == 3 and spark.table("mart_numbers").count() == 3
    with pytest.raises(ValueError):
        files.materialize(df, "x", "incremental")


def test_append_transactions_rejects_invalid(spark, tmp_dir):
    rows = spark.createDataFrame(
        [(1, "PAYMENT", Decimal("100.00"), "C1", "M1"), (2, "PAYMENT", Decimal("0.00"), "C2", "M2"),
         (3, None, Decimal("5.00"), "C3", "M3")],
        "time_step int, transaction_type string, amount decimal(18,2), sender_id string, receiver_id string",
    )
    rejected = files.append_transactions(rows, f"{tmp_dir}/tx")
    assert sorted(r["time_step"] for r in rejected.collect()) == [2, 3]
    stored = spark.read.parquet(f"{tmp_dir}/tx")
    assert stored.count() == 1 and "is_fraud" in stored.columns


def test_append_transactions_goes_on_past_values_that_don_t_fit(spark, tmp_dir):
    rows = spark.createDataFrame([("1", "PAYMENT", "100.00", "C1", "M1"), ("2", "PAYMENT", "much", "C2", "M2"), ("x", "PAYMENT", "1", "C3", "M3")],
                                 "time_step string, transaction_type string, amount string, sender_id string, receiver_id string")
    rejected = files.append_transactions(rows, f"{tmp_dir}/tx")
    assert sorted((r["sender_id"], r["reason"]) for r in rejected.collect()) == [("C2", "error"), ("C3", "error")]
    assert [r["sender_id"] for r in spark.read.parquet(f"{tmp_dir}/tx").collect()] == ["C1"]


def test_all_row_weighs_type_means_by_rows_and_velocity_groups_nulls(spark):
    from ledgerflow.operators import alerts, marts

    rows = [(1, "A", "10.00", "C1", "M1", 0.5), (2, "A", "10.00", "C1", "M1", None), (3, "B", "10.00", "C2", "M1", 0.5), (4, "ALL", "10.00", None, "M2", 0.5)]
    df = spark.createDataFrame([(t, k, Decimal(a), s, m, r) for t, k, a, s, m, r in rows], "time_step int, transaction_type string, amount decimal(18,2), sender_id string, receiver_id string, risk_score double")
    money = F.lit("5.00").cast("decimal(18,2)")
    full = df.drop("risk_score").withColumns({
        **{c: money for c in ("sender_old_balance", "sender_new_balance", "receiver_old_balance", "receiver_new_balance")}, "is_fraud": F.lit(False), "is_flagged_fraud": F.lit(False)})
    scored = enrich_transactions(full, p95=1e9).withColumn("risk_score", F.when(F.col("time_step") != 2, F.lit(0.5)))
    mart = marts.daily_transaction_summary(scored).collect()
    total = [r for r in mart if r["transaction_count"] == 4]
    assert len(mart) == 4 and len(total) == 1 and total[0]["avg_risk_score"] == 0.5
    got = {r["time_step"]: r["sender_velocity"] for r in alerts.with_velocity(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1}


def test_bundle_and_labels(spark):
    scored = enrich_transactions(fixtures.transactions(spark, SF_SMALL))
    b = metrics.analytics_bundle(scored)
    assert set(b) >= {"summary", "transaction_types", "amount_distribution", "fraud_statistics", "generated_at"}
    s = b["summary"].first()
    assert s["total_transactions"] == scored.count()
    assert sum(r["transaction_count"] for r in b["transaction_types"].collect()) == s["total_transactions"]
    lab = scored.select(hover_label(F.col("transaction_type"), F.col("amount")).alias("l")).first()["l"]
    assert "<br>Amount: $" in lab
    r = spark.createDataFrame([(0.125,), (2.675,), (1.005,)], "x double").select(round_half_even(F.col("x")).alias("r"))
    assert [x["r"] for x in r.collect()] == [0.12, 2.68, 1.0]
    scored.unpersist()


def test_col_or_prefers_first_present(spark):
    df = spark.createDataFrame([(1, 2)], "isFraud int, other int")
    assert df.select(col_or(df, "is_fraud", "isFraud")).first()[0] == 1
    with pytest.raises(KeyError):
        col_or(df, "missing")


def test_page_bounds(spark):
    df = spark.range(0, 95).withColumnRenamed("id", "k")
    assert [r["k"] for r in AL.page(df, ["k"], 10, 10).collect()] == list(range(90, 95))
    env = AL.page_envelope(df, ["k"], 2, 10).collect()
    assert env[0]["total"] == 95 and env[0]["k"] == 10 and len(env) == 10
    with pytest.raises(ValueError):
        AL.page(df, ["k"], 0, 10)
    assert [r["k"] for r in AL.head_rows(df, 3, ["k"]).collect()] == [0, 1, 2]


def test_lag_and_histogram(spark):
    msgs = spark.createDataFrame(
        [("t", 0, 5), ("t", 0, 9), ("t", 1, 3)], "topic string, partition int, offset long"
    )
    ends = consumer.end_offsets_of(msgs)
    lag = {r["partition"]: r["lag"] for r in consumer.consumer_lag(msgs.where("offset < 9"), ends).collect()}
    assert lag == {0: 10 - 5, 1: 4 - 3}
    head = {r["partition"]: r["lag"] for r in consumer.consumer_lag(msgs, ends).collect()}
    assert head == {0: 1, 1: 1}  # 1, not 0, at the head
    d = spark.createDataFrame([(0.5,), (2.0,), (30.0,), (None,)], "d double")
    h = [(r["le"], r["count"]) for r in consumer.delay_histogram(d, F.col("d"), [1.0, 10.0, 100.0]).collect()]
    assert h == [(1.0, 1), (10.0, 2), (100.0, 3)]


def test_approx_percentile_path(spark):
    tx = fixtures.transactions(spark, SF_SMALL)
    exact = enrich_transactions(tx)
    approx = enrich_transactions(tx, percentile_method="approx")
    assert approx.columns == exact.columns
    n_exact = exact.where("unusual_amount").count()
    n_approx = approx.where("unusual_amount").count()
    assert abs(n_exact - n_approx) <= max(3, n_exact // 20)


def test_lag_from_progress():
    p = {"sources": [{"latestOffset": {"tx": {"0": 120, "1": 40}}, "endOffset": {"tx": {"0": 100, "1": 40}}},
                     {"latestOffset": None, "endOffset": None}]}
    assert consumer.lag_from_progress(p) == [{"topic": "tx", "partition": 0, "lag": 20}, {"topic": "tx", "partition": 1, "lag": 0}]
    assert consumer.lag_from_progress(None) == []
