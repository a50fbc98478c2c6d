"""Seeds with lengths kept by the engine, and generated alerts in the alert table's layout."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerflow import schemas as S
from ledgerflow.operators import alerts as AL
from ledgerflow.plans.catalog import scored_transactions
from ledgerflow.sources import files


def write(path, text):
    os.makedirs(path)
    with open(f"{path}/seed.csv", "w") as f:
        f.write(text)
    return path


def test_seed_lengths(spark, tmp_dir):
    types = {"code": "char(3)", "name": "varchar(5)", "rate": "decimal(3,2)"}
    path = write(f"{tmp_dir}/csv", 'code,name,rate\nA,short,1.25\nABC,"12345  ",2\nABCD,x,1\nB,toolong,3\nC,äöüßé,0.1\nABCD,toolong,3\nD,,\n')
    stored, rejected = files.store_seed(spark, path, types, f"{tmp_dir}/table")
    assert sorted((r[0], r[1], r[2] and float(r[2])) for r in stored.collect()) == [("A  ", "short", 1.25), ("ABC", "12345", 2.0), ("C  ", "äöüßé", 0.1), ("D  ", None, None)]
    assert sorted((r.code, r.name, tuple(r.rejected)) for r in rejected.collect()) == [("ABCD", "toolong", ("code", "name")), ("ABCD", "x", ("code",)), ("B", "toolong", ("name",))]
    files.store_seed(spark, write(f"{tmp_dir}/second", "code,name,rate\nZ,z,1\n"), types, f"{tmp_dir}/table")  # replaces
    assert spark.read.parquet(f"{tmp_dir}/table").count() == 1 and spark.read.schema("code string").parquet(f"{tmp_dir}/table_rejected").count() == 0


def test_the_engine_refuses_a_long_value(spark, tmp_dir):
    spark.sql(f"CREATE TABLE seed_of_test (name varchar(5)) USING parquet LOCATION '{tmp_dir}/t'")
    try:
        with pytest.raises(PySparkException):
            spark.createDataFrame([("toolong",)], "name string").write.insertInto("seed_of_test")
    finally:
        spark.sql("DROP TABLE seed_of_test")


def test_alert_rows_fit_the_table_and_repeat(spark):
    scored = scored_transactions(spark, SF_SMALL)
    rows = AL.alert_rows(scored).persist()
    kinds = dict(rows.dtypes)
    assert all(kinds[f.name] == f.dataType.simpleString() for f in S.FRAUD_ALERT.fields)
    assert rows.count() == AL.generate_alerts(scored).count() > 0
    assert rows.where("id IS NULL OR transaction_id IS NULL OR description IS NULL").count() == 0
    assert rows.exceptAll(AL.alert_rows(scored.repartition(7))).count() == 0
    tx = AL.with_transaction_id(scored).dropDuplicates(["id"])
    assert AL.orphan_alerts(rows, tx).count() == 0
    j = AL.alerts_with_transaction(rows, tx)
    assert j.where(~F.col("amount").eqNullSafe(F.col("tx_amount").cast("double"))).count() == 0 and j.count() == rows.count()
    rows.unpersist()


def test_ids_of_incomplete_rows(spark):
    kinds = {f.name: f.dataType for f in S.TRANSACTION.fields}
    one = spark.range(1).select(*[F.lit(None).cast(kinds[c]).alias(c) for c in AL.ID_COLUMNS])
    other = one.withColumn("amount", F.lit(0).cast("decimal(18,2)"))
    a, b = AL.with_transaction_id(one).first().id, AL.with_transaction_id(other).first().id
    assert a is not None and b is not None and a != b
