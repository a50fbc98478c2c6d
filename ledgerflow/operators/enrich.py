"""Row-level transaction features (P2-P15) as one projection over the input.

The only global input is the 95th percentile of ``amount`` (P7). It is computed once, exactly and
distributed (``functions.stats``), and enters the plan as a literal: the projection stays inside one
whole-stage-codegen span with no join at all. ``percentile_method="approx"`` keeps the plan lazy: a
one-row ``percentile_approx`` aggregate is broadcast and cross-joined (J3).
"""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.functions import features as X
from ledgerflow.functions.stats import exact_percentiles, percentile_row, with_global


def canonical_transactions(df: DataFrame) -> DataFrame:
    """Canonical names and types: raw CSV spellings renamed (P1), 0/1 flags to boolean, money to DECIMAL(18,2)."""
    df = X.canonical_columns(df)
    casts = {f.name: F.col(f.name).cast(f.dataType) for f in S.TRANSACTION.fields if f.name in df.columns}
    return df.withColumns(casts)


def amount_p95(df: DataFrame) -> float | None:
    return exact_percentiles(df, "amount", [0.95])[0.95]


def enrich_transactions(
    df: DataFrame,
    *,
    p95: float | None = None,
    percentile_method: str = "exact",
) -> DataFrame:
    """transaction_date/hour/day, amount_category, high_value_transaction, unusual_amount,
    balance_change_ratio and risk_score (P2-P9), in the reference's column order."""
    df = canonical_transactions(df)
    amount = F.col("amount")
    if percentile_method == "approx" and p95 is None:
        df = with_global(df, percentile_row(df, "amount", [0.95], ["_p95"], method="approx"))
        threshold: Column = F.col("_p95")
    else:
        if p95 is None:
            p95 = amount_p95(df)
        threshold = F.lit(p95).cast("double")
    high_value = X.is_high_value(amount)
    unusual = F.coalesce(amount.cast("double") > threshold, F.lit(False))
    ratio = X.balance_change_ratio(F.col("sender_new_balance"), F.col("sender_old_balance"))
    out = X.add_time_columns(df).withColumns(
        {
            "amount_category": X.amount_category(amount),
            "high_value_transaction": high_value,
            "unusual_amount": unusual,
            "balance_change_ratio": ratio,
        }
    )
    out = out.withColumn(
        "risk_score",
        X.risk_score(
            F.col("is_fraud"),
            F.col("high_value_transaction"),
            F.col("unusual_amount"),
            F.col("balance_change_ratio"),
        ),
    )
    return out.drop("_p95") if "_p95" in out.columns else out


def process_transactions(df: DataFrame, *, processed_at: Column | None = None) -> DataFrame:
    """Warehouse transform over enriched rows: amount_usd, risk_category, hour_of_day, day_of_week,
    is_valid, processed_at (P10-P15)."""
    return df.withColumns(
        {
            "amount_usd": F.col("amount").cast("double") * F.lit(S.USD_FACTOR),
            "risk_category": X.risk_category(F.col("risk_score")),
            "hour_of_day": F.col("transaction_hour"),
            "day_of_week": X.day_name(F.col("transaction_date")),
            "is_valid": X.is_valid_transaction(df),
            "processed_at": processed_at if processed_at is not None else F.current_timestamp(),
        }
    )


def fraud_rows(df: DataFrame) -> DataFrame:
    """P17."""
    return df.where(F.col("is_fraud"))


def flagged_rows(df: DataFrame) -> DataFrame:
    """P18."""
    return df.where(F.col("is_flagged_fraud"))


def rows_of_step_day(df: DataFrame, day: str, epoch: str = S.TRANSACTION_EPOCH) -> DataFrame:
    """The rows of one day by their time steps (hours since ``epoch``): a range on a stored column."""
    first = (Date.fromisoformat(str(day)) - Date.fromisoformat(epoch[:10])).days * 24
    return df.where(F.col("time_step").between(first, first + 23))


def rows_of_day(df: DataFrame, day: str, ts_col: str = "transaction_date") -> DataFrame:
    """DATE(ts) = day, written as a half-open range on the raw column so it pushes down."""
    start = F.to_timestamp_ntz(F.lit(f"{day} 00:00:00"))
    return df.where((F.col(ts_col) >= start) & (F.col(ts_col) < start + F.expr("INTERVAL 1 DAY")))
