"""Random demo transactions, generated on the executors from ``spark.range`` (no driver-side data).

Same distributions as the reference's demo set, not the same numbers: type with fixed odds, log-normal
amount, exponential balances, 0.7 % fraud and 0.5 % flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow import schemas as S

# fixed odds of the five transaction types (same order as schemas.TRANSACTION_TYPES)
TYPE_ODDS = [0.55, 0.19, 0.13, 0.09, 0.04]
FRAUD_ODDS = 0.007
FLAGGED_ODDS = 0.005
AMOUNT_LOG_MEAN = 10.0
AMOUNT_LOG_SD = 1.0
SENDER_BALANCE_SCALE = 10000.0
RECEIVER_BALANCE_SCALE = 1000.0


def _pick(u: Column, labels: list[str], odds: list[float]) -> Column:
    expr = None
    acc = 0.0
    for label, p in zip(labels[:-1], odds[:-1]):
        acc += p
        expr = F.when(u < acc, F.lit(label)) if expr is None else expr.when(u < acc, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def _exponential(scale: float, seed: int) -> Column:
    return (-F.log1p(-F.rand(seed)) * F.lit(scale)).cast(S.MONEY)


def _account(prefix: str, seed: int) -> Column:
    n = (F.floor(F.rand(seed) * F.lit(9_000_000_000)) + F.lit(1_000_000_000)).cast("long")
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 10, "0"))


def synthetic_transactions(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n raw-layout rows (``step, type, amount, nameOrig, ...``)."""
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(0, n)
    return base.select(
        (F.floor(F.rand(seed) * 24) + 1).cast("int").alias("step"),
        _pick(F.rand(seed + 1), S.TRANSACTION_TYPES, TYPE_ODDS).alias("type"),
        F.exp(F.lit(AMOUNT_LOG_MEAN) + F.lit(AMOUNT_LOG_SD) * F.randn(seed + 2)).cast(S.MONEY).alias("amount"),
        _account("C", seed + 3).alias("nameOrig"),
        _exponential(SENDER_BALANCE_SCALE, seed + 4).alias("oldbalanceOrg"),
        _exponential(SENDER_BALANCE_SCALE, seed + 5).alias("newbalanceOrig"),
        _account("M", seed + 6).alias("nameDest"),
        _exponential(RECEIVER_BALANCE_SCALE, seed + 7).alias("oldbalanceDest"),
        _exponential(RECEIVER_BALANCE_SCALE, seed + 8).alias("newbalanceDest"),
        (F.rand(seed + 9) < FRAUD_ODDS).cast("int").alias("isFraud"),
        (F.rand(seed + 10) < FLAGGED_ODDS).cast("int").alias("isFlaggedFraud"),
    )


def first_available(loaders: list[tuple[str, callable]]) -> tuple[DataFrame, str]:
    """The first loader that answers and is not empty, with its label. Each probe is ``isEmpty``
    (a one-row limit), never a count."""
    last_error: Exception | None = None
    for label, load in loaders:
        try:
            df = load()
            if not df.isEmpty():
                return df, label
        except Exception as e:  # a source that does not answer is skipped
            last_error = e
    raise RuntimeError(f"no source returned rows (last error: {last_error})")
