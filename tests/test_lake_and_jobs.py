"""Sources, sinks and jobs: lake round trip, dynamic overwrite, fixed-DDL append, CSV/seed reads, D1-D3."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.operators.enrich import enrich_transactions
from ledgerflow.plans import jobs
from ledgerflow.sources import files, fixtures
from ledgerflow.sources.synthetic import first_available, synthetic_transactions

from conftest import SF_SMALL


def test_parquet_round_trip(spark, tmp_dir):
    df = spark.createDataFrame(
        [(1, 100.50, "USD", "completed", "credit_card"), (2, 250.75, "EUR", "pending", "bank_transfer"),
         (3, 45.99, "GBP", "failed", "digital_wallet")],
        "id long, amount double, currency string, status string, payment_method string",
    )
    back = jobs.lake_round_trip(df, f"{tmp_dir}/lake", "2024-01-02").orderBy("id")
    assert back.count() == 3
    assert back.columns[:5] == df.columns
    rows = back.collect()
    assert rows[0]["amount"] == 100.50 and rows[1]["currency"] == "EUR"


def test_dynamic_overwrite_keeps_other_dates(spark, tmp_dir):
    path = f"{tmp_dir}/lake"
    files.write_lake(spark.range(3), path, "2024-01-01")
    files.write_lake(spark.range(5), path, "2024-01-02")
    files.write_lake(spark.range(2), path, "2024-01-01")  # re-run replaces that date only
    got = {str(r["date"]): r["count"] for r in files.read_lake(spark, path).groupBy("date").count().collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 5}


def test_append_processed_fixed_ddl_and_empty(spark, tmp_dir):
    path = f"{tmp_dir}/processed"
    empty = spark.createDataFrame([], "time_step int, amount decimal(18,2)")
    assert files.append_processed(empty, path) is False
    assert not os.path.exists(path)
    df = spark.createDataFrame([(1, Decimal("12.50"), 0.25, 3), (2, Decimal("1.00"), 12.5, 3)], "time_step int, amount decimal(18,2), balance_change_ratio double, transaction_day int")
    assert files.append_processed(df, path)
    assert files.append_processed(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 2
    assert {(r["time_step"], r["balance_change_ratio"]) for r in back.collect()} == {(1, Decimal("0.2500"))}
    # 12.5 does not fit DECIMAL(5,4): the row is diverted with the value that doesn't fit
    rejected = spark.read.parquet(f"{path}_rejected").collect()
    assert len(rejected) == 2 and all(r["time_step"] == 2 and [tuple(x) for x in r["rejected"]] == [("balance_change_ratio", "12.5")] for r in rejected)
    assert dict(back.dtypes)["amount"] == "decimal(10,2)"


def test_csv_both_spellings_and_seed(spark, tmp_dir):
    for i, header in enumerate(["newbalanceOrig", "newbalanceOrg"]):
        p = f"{tmp_dir}/raw{i}.csv"
        with open(p, "w") as f:
            f.write(f"step,type,amount,nameOrig,oldbalanceOrg,{header},nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n")
            f.write("1,PAYMENT,9839.64,C1231006815,170136.0,160296.36,M1979787155,0.0,0.0,0,0\n")
        df = enrich_transactions(files.read_transactions_csv(spark, p), p95=0.0)
        r = df.first()
        assert r["sender_new_balance"] == Decimal("160296.36") and r["is_fraud"] is False
    seed = f"{tmp_dir}/seed.csv"
    with open(seed, "w") as f:
        f.write("transaction_id,amount,risk_score\nT1,10.5,0.25\n")
    s = files.read_seed(spark, seed, {"transaction_id": "varchar(255)", "amount": "decimal(10,2)", "risk_score": "decimal(3,2)"})
    assert s.first()["risk_score"] == Decimal("0.25")


def test_synthetic_and_first_available(spark):
    df = synthetic_transactions(spark, 20000, seed=1)
    assert df.count() == 20000
    types = {r["type"]: r["count"] for r in df.groupBy("type").count().collect()}
    assert set(types) == set(S.TRANSACTION_TYPES) and types["PAYMENT"] > types["DEBIT"]
    got, label = first_available([
        ("missing", lambda: spark.read.parquet("/nonexistent/path")),
        ("empty", lambda: spark.range(0)),
        ("demo", lambda: df),
    ])
    assert label == "demo"


def test_daily_lake_etl(spark, tmp_dir):
    raw = synthetic_transactions(spark, 5000, seed=3)
    res = jobs.daily_lake_etl(spark, raw, f"{tmp_dir}/lake", "2024-03-01").first()
    assert res["status"] == "success" and res["transactions_processed"] == 5000
    rows = spark.read.parquet(f"{tmp_dir}/lake/paysim_transactions")
    assert rows.count() == 5000 and "risk_score" in rows.columns
    # re-run of the same date replaces, does not add
    jobs.daily_lake_etl(spark, raw, f"{tmp_dir}/lake", "2024-03-01")
    assert spark.read.parquet(f"{tmp_dir}/lake/paysim_transactions").count() == 5000


def test_warehouse_job_and_backfill(spark, tmp_dir):
    scored = enrich_transactions(fixtures.transactions(spark, SF_SMALL))
    day = scored.select(F.to_date("transaction_date").alias("d")).groupBy("d").count().orderBy(F.desc("count")).first()["d"]
    rep = jobs.daily_warehouse_job(spark, scored, f"{tmp_dir}/wh", str(day), now=F.lit(None).cast("timestamp")).first()
    expected = scored.where(F.to_date("transaction_date") == F.lit(day)).count()
    assert rep["total_transactions"] == expected
    mart = spark.read.parquet(f"{tmp_dir}/wh/daily_transaction_summary").where(F.col("date") == F.lit(day))
    all_row = mart.where("transaction_type = 'ALL'").first()
    assert all_row["transaction_count"] == expected
    assert mart.where("transaction_type != 'ALL'").agg(F.sum("transaction_count")).first()[0] == expected
    # empty day still gives one row of zeros
    empty = jobs.metrics.daily_report(scored, "1990-01-01").first()
    assert (empty["total_transactions"], empty["total_volume"], empty["avg_risk_score"]) == (0, 0.0, 0.0)
    status = jobs.backfill(spark, scored, f"{tmp_dir}/wh2", "2017-01-01", "2017-03-31").collect()
    assert len(status) == 90
    n = scored.where(F.to_date("transaction_date").between("2017-01-01", "2017-03-31")).count()
    assert sum(r["rows"] for r in status) == n
    assert {r["status"] for r in status} <= {"success", "empty", "failed"}
    assert all((r["status"] == "empty") == (r["rows"] == 0) for r in status)


def test_csv_is_read_by_name_and_other_columns_pass(spark, tmp_dir):
    p = f"{tmp_dir}/shuffled.csv"
    with open(p, "w") as f:
        f.write("note,newbalanceOrig,oldbalanceOrg,step,type,amount,nameOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n")
        f.write("x,222,111,1,PAYMENT,9.5,C1,M1,0.0,0.0,0,0\n")
    r = enrich_transactions(files.read_transactions_csv(spark, p), p95=0.0).first()
    assert (r["sender_old_balance"], r["sender_new_balance"], r["note"]) == (111, 222, "x")


def test_rerun_replaces_declared_days_also_by_nothing(spark, tmp_dir):
    root, day, next_day = f"{tmp_dir}/wh", "2017-01-02", "2017-01-03"
    scored = enrich_transactions(fixtures.transactions(spark, SF_SMALL).limit(8).withColumn("time_step", F.lit(30)), p95=1e9)
    other = scored.withColumn("time_step", F.lit(50)).withColumn("transaction_date", F.col("transaction_date") + F.expr("INTERVAL 1 DAY"))
    rows = scored.unionByName(other)
    none = F.lit(None).cast("timestamp")
    assert [r["rows"] for r in jobs.backfill(spark, rows, root, day, next_day, now=none).orderBy("date").collect()] == [8, 8]
    assert jobs.daily_warehouse_job(spark, other, root, day, now=none).first()["total_transactions"] == 0
    status = {str(r["date"]): (r["rows"], r["status"]) for r in jobs.backfill(spark, other, root, day, next_day, now=none).collect()}
    assert status[day] == (0, "empty") and status[next_day][0] == 8
    for name in ("transactions_processed", "daily_transaction_summary"):
        assert sorted(n for n in os.listdir(f"{root}/{name}") if not n.startswith((".", "_SUCCESS"))) == [f"date={next_day}"]


def test_stored_failures_go_when_a_check_turns_clean(spark, tmp_dir):
    from ledgerflow.operators import quality

    path = f"{tmp_dir}/failures"
    checks = [quality.not_null("a", "a_there"), quality.not_null("b", "b_there")]
    quality.store_failures(spark.createDataFrame([(None, 1), (2, None)], "a int, b int"), checks, path)
    assert spark.read.parquet(path).count() == 2
    quality.store_failures(spark.createDataFrame([(1, 1), (2, None)], "a int, b int"), checks, path)
    assert [r["check_name"] for r in spark.read.parquet(path).collect()] == ["b_there"]


def test_no_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from ledgerflow.session import checkpoint_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))
