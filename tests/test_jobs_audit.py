"""D3 keeps failed days as they were, D1's metrics are observed while it writes, S7/S14 loads can be repeated, A10 in one pass."""

import pytest
from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.operators import metrics
from ledgerflow.operators.enrich import enrich_transactions
from ledgerflow.plans import jobs
from ledgerflow.sources import files, fixtures

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def now(spark):
    return F.lit(None).cast("timestamp")


@pytest.fixture(scope="module")
def scored(spark):
    return enrich_transactions(fixtures.transactions(spark, SF_SMALL), p95=1e9)


def days_of(scored, n=3):
    base = scored.limit(8)
    day = lambda d: base.withColumn("transaction_date", F.to_timestamp_ntz(F.lit(f"2020-05-0{d} 10:00:00")))
    out = day(1)
    for d in range(2, n + 1):
        out = out.unionByName(day(d))
    return out


def stored(spark, root):
    return {str(r.date): (r["count"], r.a) for r in files.read_lake(spark, f"{root}/transactions_processed").groupBy("date").agg(F.count(F.lit(1)).alias("count"), F.sum("amount").alias("a")).collect()}


def test_failed_and_broken_days_keep_what_is_stored(spark, tmp_dir, scored, now):
    root, rows = f"{tmp_dir}/wh", days_of(scored)
    assert {r.status for r in jobs.backfill(spark, rows, root, "2020-05-01", "2020-05-04", now=now).collect()} == {"success", "empty"}
    before = stored(spark, root)
    assert set(before) == {f"2020-05-0{d}" for d in (1, 2, 3)}
    day = F.dayofmonth("transaction_date")
    # day 1: senders are missing; day 2: a row that can't be processed; day 3: other amounts
    broken = rows.withColumns({
        "sender_id": F.when(day != 1, F.col("sender_id")),
        "amount": F.when(day == 2, F.raise_error(F.lit("broken row")).cast("decimal(18,2)")).when(day == 3, F.col("amount") + 1).otherwise(F.col("amount")).cast(rows.schema["amount"].dataType)})
    status = {str(r.date)[-1]: r.status for r in jobs.backfill(spark, broken, root, "2020-05-01", "2020-05-04", now=now, error_above=7).collect()}
    assert status == {"1": "failed", "2": "error", "3": "success", "4": "empty"}
    after = stored(spark, root)
    assert after["2020-05-01"] == before["2020-05-01"] and after["2020-05-02"] == before["2020-05-02"] and after["2020-05-03"] == (8, before["2020-05-03"][1] + 8)
    mart = files.read_lake(spark, f"{root}/daily_transaction_summary")
    assert mart.where("transaction_type = 'ALL'").count() == 3
    failures = files.read_lake(spark, f"{root}/dq_failures_by_date").where("check_name = 'check_sender_id_not_null'")
    assert [(str(r.date), r["count"]) for r in failures.groupBy("date").count().collect()] == [("2020-05-01", 8)]


@pytest.mark.parametrize("other", [False, True])
def test_observed_metrics_equal_their_own_pass(spark, tmp_dir, scored, other):
    rows = scored.withColumns({"transaction_type": F.when(F.col("time_step") % 11 == 0, F.lit("REFUND" if other else None)).otherwise(F.col("transaction_type"))})
    path = f"{tmp_dir}/rows"
    observed, finished = metrics.observed_fraud_metrics(rows, lambda: spark.read.parquet(path))
    observed.write.parquet(path)
    flat = lambda m: {k: dict(v) if isinstance(v, dict) else v for k, v in m.first().asDict().items()}
    assert flat(finished()) == flat(metrics.fraud_metrics(rows))
    empty, finished = metrics.observed_fraud_metrics(rows.limit(0), lambda: rows)
    empty.write.parquet(f"{tmp_dir}/none")
    assert finished().first()["total_transactions"] == 0


def test_a_repeated_load_is_one_load(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    df = spark.createDataFrame([(1, 12.5, 0.25), (2, 1.0, 12.5)], "time_step int, amount double, balance_change_ratio double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    for load in ("a", "b", "a"):
        assert files.append_processed(df, path, load_id=load)
    assert files.read_loads(spark, path, S.PROCESSED_TRANSACTION).count() == 2
    assert files.read_lake(spark, f"{path}_rejected").groupBy("load_id").count().count() == 2
    # the same load with fewer rows replaces what it has left
    assert files.append_processed(df.limit(0), path, load_id="a") is False
    assert files.read_loads(spark, path, S.PROCESSED_TRANSACTION).count() == 1
    assert files.append_processed(df.limit(0), f"{tmp_dir}/new", load_id="a") is False and not files.path_exists(spark, f"{tmp_dir}/new")
    with pytest.raises(ValueError):
        files.append_processed(df, path, load_id="../a")


def test_bundle_reads_its_input_once_and_equals_the_metrics(spark, tmp_dir, scored):
    rows = scored.select("transaction_type", "time_step", "amount", "is_fraud", "is_flagged_fraud")
    rows.write.parquet(f"{tmp_dir}/in")
    source = spark.read.parquet(f"{tmp_dir}/in")
    assert metrics.bundle_aggregate(source)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    bundle = metrics.analytics_bundle(source)
    same = {
        "summary": metrics.summary, "transaction_types": metrics.type_distribution, "transactions_by_step": metrics.transactions_by_step, "amount_distribution": metrics.amount_distribution,
        "fraud_by_type": metrics.fraud_by_type, "fraud_amount_stats": metrics.fraud_amount_stats, "fraud_by_step": metrics.fraud_by_step, "fraud_statistics": metrics.detection_stats}
    for name, own in same.items():
        got, want = bundle[name], own(source)
        assert got.columns == want.columns
        key = None if "step" in name else list
        assert (sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))) if key is None else list(map(tuple, got.collect())) == list(map(tuple, want.collect()))
        none = metrics.analytics_bundle(source.limit(0))[name].collect() if name in ("summary", "fraud_statistics") else None
        assert none is None or list(map(tuple, none)) == list(map(tuple, own(source.limit(0)).collect()))
