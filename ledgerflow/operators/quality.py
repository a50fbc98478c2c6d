"""Table-level data-quality checks with thresholds and stored failures (Q1-Q9).

Row checks are predicates that mark a *failing* row. All row checks of a table run as one aggregate of
``count_if`` (one scan, map-side partial counts). With a unique key, the row checks ride along the key's
grouping, so the whole suite is still one scan; referential integrity is one anti join. Output: one row per check ``(check_name, failed_rows, status)``:

* ``pass`` when nothing fails,
* ``fail_soft`` for 1..warn_above failing rows,
* ``warn`` above ``warn_above`` (100), ``error`` above ``error_above`` (1000).

``store_failures`` writes the failing rows once, tagged with every check they fail, partitioned by check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import schemas as S


@dataclass(frozen=True)
class RowCheck:
    name: str
    failing: Column  # true on a failing row; null counts as passing


def status_of(failed: Column, warn_above: int = S.DQ_WARN_ABOVE, error_above: int = S.DQ_ERROR_ABOVE) -> Column:
    return (
        F.when(failed == 0, F.lit("pass"))
        .when(failed > error_above, F.lit("error"))
        .when(failed > warn_above, F.lit("warn"))
        .otherwise(F.lit("fail_soft"))
    )


# --- check constructors ------------------------------------------------------------------------


def not_null(column: str, name: str | None = None) -> RowCheck:
    """Q1, Q6 not_null."""
    return RowCheck(name or f"{column}_not_null", F.col(column).isNull())


def in_range(column: str, low: float, high: float, name: str | None = None) -> RowCheck:
    """Q2, Q5: outside [low, high] fails (null passes)."""
    c = F.col(column)
    return RowCheck(name or f"{column}_in_range", (c < low) | (c > high))


def at_most(column: str, high: float, name: str) -> RowCheck:
    return RowCheck(name, F.col(column) > high)


def positive(column: str, name: str | None = None) -> RowCheck:
    """Q5: amount <= 0 fails."""
    return RowCheck(name or f"{column}_positive", F.col(column) <= 0)


def parses_as_timestamp(df: DataFrame, column: str, name: str | None = None) -> RowCheck:
    """Q3: a string that does not parse fails; a typed timestamp fails only when null."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        return RowCheck(name or f"{column}_parses", c.isNull() | F.try_to_timestamp(c).isNull())
    return RowCheck(name or f"{column}_parses", c.isNull())


def not_empty(column: str, name: str | None = None) -> RowCheck:
    """Q4: null or blank fails."""
    c = F.col(column)
    return RowCheck(name or f"{column}_not_empty", c.isNull() | (F.trim(c) == ""))


def allowed_values(column: str, values: list[str], name: str | None = None) -> RowCheck:
    """Q8: a value outside the set fails (null passes, as ``isin`` gives null)."""
    return RowCheck(name or f"{column}_allowed", ~F.col(column).isin(values))


# --- runners -------------------------------------------------------------------------------------


def run_row_checks(df: DataFrame, checks: list[RowCheck]) -> DataFrame:
    """All row checks in one aggregate, unpivoted to one row per check."""
    wide = df.agg(*[F.count_if(F.coalesce(c.failing, F.lit(False))).alias(c.name) for c in checks])
    long = wide.unpivot([], [c.name for c in checks], "check_name", "failed_rows")
    return long.withColumn("status", status_of(F.col("failed_rows")))


def _keys_present(columns: list[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond


def run_checks_with_key(df: DataFrame, checks: list[RowCheck], key: list[str], unique_name: str) -> DataFrame:
    """Row checks and the unique-key check in one pass: the rows are grouped by the key once (map-side
    combined, so a hot key is one partial row per task) carrying the failure flags, then a small global
    aggregate sums the flags and counts the keys seen more than once."""
    flags = [F.coalesce(c.failing, F.lit(False)).cast("int").alias(f"_f{i}") for i, c in enumerate(checks)]
    per_key = (
        df.select(*key, *flags)
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_f{i}").alias(f"_f{i}") for i in range(len(checks))])
    )
    wide = per_key.agg(
        *[F.coalesce(F.sum(f"_f{i}"), F.lit(0)).cast("long").alias(c.name) for i, c in enumerate(checks)],
        F.count_if((F.col("_n") > 1) & _keys_present(key)).alias(unique_name),
    )
    names = [c.name for c in checks] + [unique_name]
    long = wide.unpivot([], names, "check_name", "failed_rows")
    return long.withColumn("status", status_of(F.col("failed_rows")))


def unique_check(df: DataFrame, columns: list[str], name: str | None = None) -> DataFrame:
    """Q6 unique: the number of key values (nulls excluded) that occur more than once (the dbt count)."""
    dup = df.where(_keys_present(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    nm = name or f"{'_'.join(columns)}_unique"
    return dup.agg(F.count(F.lit(1)).alias("failed_rows")).select(
        F.lit(nm).alias("check_name"), "failed_rows", status_of(F.col("failed_rows")).alias("status")
    )


def referential_check(child: DataFrame, fk: str, parent: DataFrame, pk: str, name: str | None = None) -> DataFrame:
    """Q9: child rows whose key has no parent (left anti join, J2)."""
    orphans = child.select(fk).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    nm = name or f"{fk}_references_{pk}"
    return orphans.agg(F.count(F.lit(1)).alias("failed_rows")).select(
        F.lit(nm).alias("check_name"), "failed_rows", status_of(F.col("failed_rows")).alias("status")
    )


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q7: a null count per column as check rows."""
    return run_row_checks(df, [not_null(c, f"{c}_complete") for c in (columns or df.columns)])


def failing_rows(df: DataFrame, checks: list[RowCheck]) -> DataFrame:
    """Every failing row once per check it fails, with the check's name."""
    tags = F.array_compact(
        F.array(*[F.when(F.coalesce(c.failing, F.lit(False)), F.lit(c.name)) for c in checks])
    )
    return df.withColumn("_failed", tags).where(F.size("_failed") > 0).select(
        "*", F.explode("_failed").alias("check_name")
    ).drop("_failed")


def store_failures(df: DataFrame, checks: list[RowCheck], path: str) -> None:
    """Write the failing rows (one scan) under ``path/check_name=...``; a re-run replaces all these checks,
    those without failing rows too."""
    from ledgerflow.sources.files import replace_partitions

    replace_partitions(failing_rows(df, checks), path, "check_name", [c.name for c in checks])


# --- the suites of the reference ----------------------------------------------------------------


def transaction_checks(df: DataFrame) -> list[RowCheck]:
    """The warehouse job's four checks plus the amount bounds of the project variables."""
    return [
        not_null("amount", "check_transaction_amounts_not_null"),
        in_range("risk_score", 0.0, 1.0, "check_risk_scores_in_range"),
        parses_as_timestamp(df, "transaction_date", "check_timestamp_format"),
        not_empty("receiver_id", "check_merchant_names_not_empty"),
        in_range("amount", S.MIN_AMOUNT, S.MAX_AMOUNT, "check_amount_within_bounds"),
        positive("amount", "check_amount_positive"),
        at_most("amount", S.UNREASONABLE_AMOUNT, "check_amount_reasonable"),
        not_null("sender_id", "check_sender_id_not_null"),
    ]


def transaction_quality(df: DataFrame) -> DataFrame:
    return run_checks_with_key(df, transaction_checks(df), S.UPSERT_KEY, "check_transaction_key_unique")


def payment_quality(payments: DataFrame) -> DataFrame:
    checks = [
        allowed_values("status", S.PAYMENT_STATUSES, "check_status_allowed"),
        positive("amount", "check_amount_positive"),
        at_most("amount", S.UNREASONABLE_AMOUNT, "check_amount_reasonable"),
        not_null("id", "check_id_not_null"),
        not_null("currency", "check_currency_not_null"),
        not_null("payment_method", "check_payment_method_not_null"),
    ]
    return run_checks_with_key(payments, checks, ["id"], "check_id_unique")


def alert_quality(alerts: DataFrame, transactions: DataFrame, tx_key: str = "id") -> DataFrame:
    checks = [
        in_range("risk_score", 0.0, 1.0, "check_risk_scores_in_range"),
        allowed_values("alert_type", S.ALERT_TYPES, "check_alert_type_allowed"),
        allowed_values("status", S.ALERT_STATUSES, "check_alert_status_allowed"),
        not_null("transaction_id", "check_transaction_id_not_null"),
    ]
    return run_row_checks(alerts, checks).unionByName(
        referential_check(alerts, "transaction_id", transactions, tx_key, "check_alert_transaction_exists")
    )
