"""Batch jobs (D1-D4) built from the operators.

Each job is one Spark lineage per output, cut by writing: what a job writes is what its next step reads
(column-pruned Parquet), so a lost executor re-runs at most the stage that was running, never the whole
chain, and nothing is cached across steps. Re-running a job for the same date(s) replaces exactly those
date partitions, also by nothing where the input has no rows for a date any more.
"""

from __future__ import annotations

import logging
from datetime import date as Date
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators import marts, metrics, quality
from ledgerflow.operators.enrich import canonical_transactions, enrich_transactions, process_transactions
from ledgerflow.functions.stats import exact_percentiles
from ledgerflow.session import work_path
from ledgerflow.sources import files

log = logging.getLogger(__name__)


def _yesterday() -> str:
    return (datetime.now() - timedelta(days=1)).date().isoformat()


def _stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared work folder and read it back (lineage cut, pruned re-reads). The caller
    removes the folder, the second value."""
    path = work_path(df.sparkSession, "staging", name, unique=True)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path), path


# --- D1 ------------------------------------------------------------------------------------------


def daily_lake_etl(spark: SparkSession, source: DataFrame, lake_root: str, run_date: str | None = None,
                   *, stage_input: bool = True) -> DataFrame:
    """Raw rows -> features and risk score -> lake partition of the run date, plus the metrics row.

    As in the reference, the *whole* input is written under the run date (default: yesterday). The input
    is staged once (the percentile reads the amount column, the feature pass reads all columns); the
    metrics are observed while the rows are written. Returns the job result row (A24); a failure gives a
    row with status ``error`` instead of raising.
    """
    day = run_date or _yesterday()
    folder = None
    try:
        base = canonical_transactions(source)
        if stage_input:
            base, folder = _stage(base, "d1-input")
        p95 = exact_percentiles(base, "amount", [0.95])[0.95]
        enriched = enrich_transactions(base, p95=p95)
        rows_path = f"{lake_root.rstrip('/')}/paysim_transactions"
        written = lambda: files.read_lake(spark, rows_path).where(F.col("date") == F.lit(day).cast("date"))
        observed, finished = metrics.observed_fraud_metrics(enriched, written)
        files.write_lake(observed, rows_path, day)
        m = finished()
        files.write_lake(m, f"{lake_root.rstrip('/')}/fraud_metrics", day)
        stored = files.read_lake(spark, f"{lake_root.rstrip('/')}/fraud_metrics").where(F.col("date") == F.lit(day).cast("date")).drop("date")
        return metrics.job_result(stored, status="success", run_date=day)
    except Exception as e:  # the job reports instead of raising, like the reference
        return spark.createDataFrame(
            [("error", day, str(e))], "status string, date string, error string"
        ).withColumn("date", F.to_date("date"))
    finally:
        if folder:
            files.remove_path(spark, folder)


# --- D2 ------------------------------------------------------------------------------------------


def daily_warehouse_job(spark: SparkSession, transactions: DataFrame, warehouse_root: str, day: str | Date,
                        *, now=None) -> DataFrame:
    """Rows of one date -> processed table (that date's partition replaced) -> mart rows of that date
    -> quality checks with stored failures -> the daily report row (A17)."""
    day = str(day)
    root = warehouse_root.rstrip("/")
    rows = files.read_transactions_for_date(transactions, day)
    processed = process_transactions(rows, processed_at=now).withColumn("date", F.to_date("transaction_date"))
    stored = _load_days(spark, processed, root, [day])
    checks = quality.transaction_checks(stored)
    quality.store_failures(stored.withColumn("run_date", F.lit(day)), checks, f"{root}/dq_failures/run_date={day}")
    results = quality.transaction_quality(stored).withColumn("date", F.lit(day).cast("date"))
    files.replace_partitions(results, f"{root}/dq_results", "date", [day])
    return metrics.daily_report(stored, day, generated_at=now)


def _load_days(spark: SparkSession, processed: DataFrame, root: str, days: list[str]) -> DataFrame:
    """Replace the declared days of the processed table and of the mart; the days' stored rows."""
    files.replace_partitions(processed, f"{root}/transactions_processed", "date", days)
    schema = T.StructType([*[f for f in processed.schema.fields if f.name != "date"], T.StructField("date", T.DateType())])
    stored = files.read_lake(spark, f"{root}/transactions_processed", schema).where(F.col("date").isin([Date.fromisoformat(d) for d in days]))
    mart = marts.daily_transaction_summary(stored, ordered=False)
    files.replace_partitions(mart, f"{root}/daily_transaction_summary", "date", days)
    return stored


# --- D3 ------------------------------------------------------------------------------------------


def backfill(spark: SparkSession, transactions: DataFrame, warehouse_root: str, start: str, end: str,
             *, now=None, error_above: int = quality.S.DQ_ERROR_ABOVE) -> DataFrame:
    """D3: the inclusive date range as one job (not a loop of daily jobs): write, audit, publish.

    All dates' processed rows are written to the work folder and audited per date. Dates that pass (or are empty) replace
    what is stored of the processed table and the mart, in one publish each; a failed date keeps what was stored of it. The
    failing rows of all dates are stored. Returns one status row per date: ``success``, ``empty`` (no rows), ``failed`` (more
    than ``error_above`` failing rows of a check) or ``error`` (its rows can't be processed), with its counts.
    """
    root = warehouse_root.rstrip("/")
    staging = work_path(spark, "staging", "backfill", unique=True)
    written, broken = _stage_days(transactions, staging, files.days_between(start, end), now)
    try:
        schema = T.StructType([*[f for f in process_transactions(transactions, processed_at=now).schema.fields], T.StructField("date", T.DateType())])
        staged = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*written) if written else spark.createDataFrame([], schema)
        status = backfill_status(staged, start, end, error_above)
        status = status.withColumn("status", F.when(F.col("date").cast("string").isin(broken), F.lit("error")).otherwise(F.col("status"))) if broken else status
        result = work_path(spark, "backfill-status", unique=True)
        status.coalesce(1).write.parquet(result)
        status = spark.read.schema(status.schema).parquet(result)
        kept = {str(r["date"]) for r in status.where(F.col("status").isin("failed", "error")).select("date").collect()}  # a row per date at most
        good = [d for d in files.days_between(start, end) if d not in kept]
        if good:
            _load_days(spark, staged.where(F.col("date").cast("string").isin(good)), root, good)
        audited = [d for d in files.days_between(start, end) if d not in broken]
        if audited:
            files.replace_partitions(quality.failing_rows(staged, quality.transaction_checks(staged)), f"{root}/dq_failures_by_date", "date", audited)
        return status
    finally:
        files.remove_path(spark, staging)


def _stage_days(transactions: DataFrame, staging: str, days: list[str], now) -> tuple[list[str], list[str]]:
    """Write the processed rows of consecutive days: (folders, days whose rows can't be processed). A range that fails is
    halved until the failing days stand alone, so one bad day costs some more jobs and no other day."""
    ts = F.col("transaction_date")
    lo, hi = (F.to_timestamp_ntz(F.lit(f"{d} 00:00:00")) for d in (days[0], days[-1]))
    rows = transactions.where((ts >= lo) & (ts < hi + F.expr("INTERVAL 1 DAY")))
    folder = f"{staging}/{days[0]}-{len(days)}"
    try:
        process_transactions(rows, processed_at=now).withColumn("date", F.to_date(ts)).write.parquet(folder)
        return [folder], []
    except Exception as e:
        log.warning("days %s to %s can't be processed: %s", days[0], days[-1], str(e).split("\n")[0])
        if len(days) == 1:
            return [], days
    half = len(days) // 2
    parts = [_stage_days(transactions, staging, some, now) for some in (days[:half], days[half:])]
    return parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]


def backfill_status(stored: DataFrame, start: str, end: str, error_above: int = quality.S.DQ_ERROR_ABOVE) -> DataFrame:
    """One row per date of the range: rows, fraud rows, failing-check counts and status."""
    spark = stored.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    )
    checks = quality.transaction_checks(stored)
    per_day = stored.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("is_fraud")).alias("fraud_rows"),
        F.greatest(*[F.count_if(F.coalesce(c.failing, F.lit(False))) for c in checks]).alias("worst_check_failures"),
    )
    status = (
        F.when(F.coalesce("rows", F.lit(0)) == 0, F.lit("empty"))
        .when(F.col("worst_check_failures") > error_above, F.lit("failed"))
        .otherwise(F.lit("success"))
    )
    return days.join(per_day, "date", "left").select(
        "date",
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        F.coalesce("fraud_rows", F.lit(0)).cast("long").alias("fraud_rows"),
        F.coalesce("worst_check_failures", F.lit(0)).cast("long").alias("worst_check_failures"),
        status.alias("status"),
    )


# --- D4 ------------------------------------------------------------------------------------------


def lake_round_trip(df: DataFrame, lake_path: str, run_date: str) -> DataFrame:
    """Write one date partition and read it back (same rows, columns and values, plus ``date``)."""
    files.write_lake(df, lake_path, run_date)
    return files.read_lake(df.sparkSession, lake_path).where(F.col("date") == F.lit(run_date).cast("date"))
