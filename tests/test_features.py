"""Edge rows of the row-level features (bins, ratio at old = -1, NaN, floor arithmetic, score sums)."""

import math
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.functions import features as X
from ledgerflow.operators.enrich import enrich_transactions, process_transactions


def test_amount_bins_right_closed(spark):
    df = spark.createDataFrame(
        [(Decimal(v) if v is not None else None,) for v in ["-5", "0", "0.01", "100", "100.01", "1000", "1000.01", "10000", "10000.01", None]],
        "amount decimal(18,2)",
    )
    got = [r[0] for r in df.select(X.amount_category(F.col("amount"))).collect()]
    assert got == [None, None, "small", "small", "medium", "medium", "large", "large", "very_large", None]


def test_high_value_null_is_false(spark):
    df = spark.createDataFrame([(None,), (Decimal("10000"),), (Decimal("10000.01"),)], "amount decimal(18,2)")
    assert [r[0] for r in df.select(X.is_high_value(F.col("amount"))).collect()] == [False, False, True]


def test_ratio_at_minus_one_gives_inf_and_nan(spark):
    df = spark.createDataFrame([(-1.0, 5.0), (-1.0, -1.0), (99.0, 149.0)], "old double, new double")
    got = [r[0] for r in df.select(X.balance_change_ratio(F.col("new"), F.col("old"))).collect()]
    assert got[0] == math.inf
    assert math.isnan(got[1])
    assert got[2] == 0.5


def test_nan_and_null_do_not_pass_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.51,), (float("inf"),)], "r double")
    assert [r[0] for r in df.select(X.gt_not_nan(F.col("r"), 0.5)).collect()] == [False, False, True, True]


def test_floor_mod_and_div_like_pandas(spark):
    df = spark.createDataFrame([(-5,), (0,), (23,), (24,), (-24,), (-25,)], "t int")
    rows = df.select(X.floor_mod(F.col("t"), 24), X.floor_div(F.col("t"), 24)).collect()
    assert [tuple(r) for r in rows] == [(t % 24, t // 24) for t in (-5, 0, 23, 24, -24, -25)]


def test_risk_score_sums_doubles_in_order(spark):
    df = spark.createDataFrame(
        [(True, True, True, 1.0), (False, True, True, 0.0), (False, False, True, 0.9), (True, False, False, float("nan"))],
        "f boolean, h boolean, u boolean, r double",
    )
    got = [r[0] for r in df.select(X.risk_score(F.col("f"), F.col("h"), F.col("u"), F.col("r"))).collect()]
    assert got == [0.8 + 0.3 + 0.2 + 0.1, 0.0 + 0.3 + 0.2 + 0.0, 0.0 + 0.0 + 0.2 + 0.1, 0.8 + 0.0 + 0.0 + 0.0]


def test_risk_category_float_sum_is_medium(spark):
    df = spark.createDataFrame([(0.0,), (0.2 + 0.1,), (0.3,), (0.7,), (1.0,), (1.1,), (None,)], "s double")
    got = [r[0] for r in df.select(X.risk_category(F.col("s"))).collect()]
    assert got == [None, "medium", "low", "medium", "high", None, None]


def test_enrich_raw_layout_and_time_columns(spark):
    raw = spark.createDataFrame(
        [(1, "PAYMENT", Decimal("9839.64"), "C1", Decimal("170136.00"), Decimal("160296.36"), "M1",
          Decimal("0"), Decimal("0"), 0, 0),
         (25, "TRANSFER", Decimal("181.00"), "C2", Decimal("181.00"), Decimal("0"), "C3", Decimal("0"), Decimal("0"), 1, 1),
         (-1, "DEBIT", Decimal("20000.00"), "C4", Decimal("-1.00"), Decimal("-1.00"), "M2", Decimal("0"), Decimal("0"), 0, 0)],
        "step int, type string, amount decimal(18,2), nameOrig string, oldbalanceOrg decimal(18,2), "
        "newbalanceOrg decimal(18,2), nameDest string, oldbalanceDest decimal(18,2), newbalanceDest decimal(18,2), "
        "isFraud int, isFlaggedFraud int",
    )
    out = enrich_transactions(raw).orderBy("time_step").collect()
    first, second, third = out
    assert str(second["transaction_date"]) == "2017-01-01 01:00:00"
    assert (first["transaction_hour"], first["transaction_day"]) == (23, -1)
    assert (third["transaction_hour"], third["transaction_day"]) == (1, 1)
    # old = -1 and new = old: NaN ratio, which adds nothing to the score
    assert math.isnan(first["balance_change_ratio"])
    assert first["high_value_transaction"] and first["risk_score"] == 0.3 + 0.2
    assert third["is_fraud"] is True and third["risk_score"] == 0.8 + 0.1
    assert second["risk_score"] == 0.0
    p = process_transactions(enrich_transactions(raw), processed_at=F.lit(None).cast("timestamp")).collect()
    assert {r["day_of_week"] for r in p} <= {"Saturday", "Sunday", "Monday"}
    assert all(r["is_valid"] for r in p)
