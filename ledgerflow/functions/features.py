"""Column expressions for the transaction features (all native, codegen'd; no Python UDF).

Conventions that differ from pandas and are handled here:

* Spark's ``%`` and integral ``div`` truncate toward zero; pandas floors. ``pmod`` and an exact floor
  division are used instead.
* ANSI mode raises on ``x / 0``; pandas yields ``inf``/``NaN``. The ratio spells those out.
* Spark orders ``NaN`` above every number, so ``NaN > 0.5`` is true in Spark but false in pandas.
  Threshold tests guard against ``NaN`` explicitly.
* SQL literals such as ``0.3`` are DECIMAL; weights are added as doubles in the reference's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow import schemas as S


def col_or(df: DataFrame, *names: str) -> Column:
    """First of ``names`` that exists in ``df`` (raw or canonical spelling), resolved at plan time."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise KeyError(f"none of {names} in {df.columns}")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename raw CSV names to canonical ones; unknown columns pass through."""
    mapping = {k: v for k, v in S.RAW_TO_CANONICAL.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(mapping) if mapping else df


def transaction_date(time_step: Column) -> Column:
    """Epoch + ``time_step`` hours as TIMESTAMP_NTZ (time-zone free)."""
    epoch = F.to_timestamp_ntz(F.lit(S.TRANSACTION_EPOCH))
    return epoch + F.make_dt_interval(hours=time_step.cast("int"))


def floor_mod(x: Column, n: int) -> Column:
    """Floor modulo like pandas ``%``."""
    return F.pmod(x, F.lit(n))


def floor_div(x: Column, n: int) -> Column:
    """Exact floor division like pandas ``//`` for integers."""
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("long")


def amount_category(amount: Column) -> Column:
    """Right-closed bins; zero, negative and null give null."""
    expr = F.when(amount.isNull() | (amount <= 0), F.lit(None).cast("string"))
    for edge, label in S.AMOUNT_BINS:
        expr = expr.when(amount <= edge, F.lit(label))
    return expr.otherwise(F.lit(S.AMOUNT_TOP_LABEL))


def is_high_value(amount: Column) -> Column:
    """amount > 10000; null gives false."""
    return F.coalesce(amount > S.HIGH_VALUE_THRESHOLD, F.lit(False))


def gt_not_nan(x: Column, threshold: Column | float) -> Column:
    """``x > threshold`` with pandas semantics: null and NaN give false."""
    return F.coalesce((x > threshold) & ~F.isnan(x), F.lit(False))


def balance_change_ratio(new: Column, old: Column) -> Column:
    """abs(new - old) / (old + 1) as double; old = -1 gives +inf, or NaN when new = old."""
    num = F.abs(new.cast("double") - old.cast("double"))
    den = old.cast("double") + F.lit(1.0)
    return (
        F.when(den == 0, F.when(num == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
        .otherwise(num / den)
    )


def risk_score(is_fraud: Column, high_value: Column, unusual: Column, ratio: Column) -> Column:
    """0.8·fraud + 0.3·high value + 0.2·unusual + 0.1·(ratio > 0.5), summed as doubles in this order."""
    w = S.RISK_WEIGHTS

    def term(flag: Column, weight: float) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))

    return (
        term(is_fraud, w["is_fraud"])
        + term(high_value, w["high_value"])
        + term(unusual, w["unusual"])
        + term(gt_not_nan(ratio, S.RATIO_THRESHOLD), w["ratio"])
    )


def risk_category(score: Column) -> Column:
    """(0,0.3] low, (0.3,0.7] medium, (0.7,1] high; 0, > 1 and null give null."""
    expr = F.when(score.isNull() | F.isnan(score) | (score <= 0), F.lit(None).cast("string"))
    for edge, label in S.RISK_BINS:
        expr = expr.when(score <= edge, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def day_name(ts: Column) -> Column:
    """Full English day name."""
    return F.date_format(ts, "EEEE")


def is_valid_transaction(df: DataFrame) -> Column:
    """Row validator: the five required fields are non-null and amount > 0."""
    req = [col_or(df, c) for c in S.REQUIRED_STREAM_FIELDS]
    cond = F.lit(True)
    for c in req:
        cond = cond & c.isNotNull()
    return F.coalesce(cond & (F.col("amount") > 0), F.lit(False))


def round_half_even(x: Column, places: int = 2) -> Column:
    """Rounding as NumPy does it (P31); ``F.round`` is half-up."""
    return F.bround(x, places)


def hover_label(tx_type: Column, amount: Column) -> Column:
    """``TYPE<br>Amount: $123.45``."""
    return F.concat(tx_type, F.lit("<br>Amount: $"), amount.cast("string"))


def add_time_columns(df: DataFrame) -> DataFrame:
    """transaction_date, transaction_hour, transaction_day from time_step."""
    ts = F.col("time_step")
    return df.withColumns(
        {
            "transaction_date": transaction_date(ts),
            "transaction_hour": floor_mod(ts, 24).cast("int"),
            "transaction_day": floor_div(ts, 24).cast("int"),
        }
    )
