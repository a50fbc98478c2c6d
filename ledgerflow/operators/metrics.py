"""Fraud and volume metrics.

Global metrics are single aggregates with conditional expressions, so one scan serves many numbers and
partial aggregation runs map-side: a hot transaction type or step only grows a partial sum. Grouped
metrics shuffle on their key after the map-side combine. Means come from exact decimal sums.

"Rates" differ on purpose and are named apart: ``fraud_rate`` in A1 is a fraction, in A2/A13 a percent;
"high risk" is risk_score > 0.5 in A1, > 0.7 in A17, and the overlapping sum of A14.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.functions import features as X
from ledgerflow.functions.stats import exact_percentiles
from ledgerflow.session import work_path

RISK_SUM_TYPE = "decimal(20,4)"


def exact_mean(c: Column) -> Column:
    """sum / count with the sum taken in DECIMAL for money, then cast to double."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def risk_mean(c: Column) -> Column:
    return F.try_divide(F.sum(c.cast(RISK_SUM_TYPE)).cast("double"), F.count(c))


def _map_text(m: Column) -> Column:
    """A map as ``k:v,k:v`` in key order (a comparable rendering of a value_counts dict)."""
    return F.array_join(
        F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))),
        ",",
    )


# --- A1 --------------------------------------------------------------------------------------------


def fraud_metrics(df: DataFrame) -> DataFrame:
    """A1: one row; counts by type and fraud counts by type as maps.

    First a per-type aggregate (one row per transaction type: the map's size is the type domain), then a
    global aggregate over those rows; the data is scanned once.
    """
    return _of_types(df.groupBy("transaction_type").agg(*_type_measures(F.lit(True))))


def _type_measures(here: Column, tag: str = "") -> list[Column]:
    """The additive measures of the rows where ``here`` holds."""
    risk, amount = F.when(here, F.col("risk_score")), F.when(here, F.col("amount"))
    fraud = here & F.col("is_fraud")
    return [
        F.count_if(here).alias(f"n{tag}"),
        F.count_if(fraud).alias(f"nf{tag}"),
        F.sum(amount).alias(f"amt{tag}"),
        F.count(amount).alias(f"amt_n{tag}"),
        F.sum(F.when(fraud, F.col("amount"))).alias(f"famt{tag}"),
        F.count(F.when(fraud, F.col("amount"))).alias(f"famt_n{tag}"),
        F.sum(risk.cast(RISK_SUM_TYPE)).alias(f"rsum{tag}"),
        F.count(risk).alias(f"rn{tag}"),
        F.count_if(X.gt_not_nan(risk, 0.5)).alias(f"hr{tag}"),
    ]


def observed_fraud_metrics(df: DataFrame, stored: Callable[[], DataFrame]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """A1 of rows while they are written, without a pass of their own: (the rows to write, a function that gives the metrics
    row after the write). The known transaction types are observed; if rows of other types passed, the metrics
    are taken from ``stored()`` instead."""
    kind = F.col("transaction_type")
    groups = [*S.TRANSACTION_TYPES, None]
    here = [kind.isNull() if t is None else F.coalesce(kind == t, F.lit(False)) for t in groups]
    seen = Observation()
    measures = [m for i, h in enumerate(here) for m in _type_measures(h, f"_{i}")]
    other = F.count_if(kind.isNotNull() & ~F.coalesce(kind.isin(S.TRANSACTION_TYPES), F.lit(False))).alias("other")

    def finished() -> DataFrame:
        got = seen.get
        if got["other"]:
            return fraud_metrics(stored())
        names = ["n", "nf", "amt", "amt_n", "famt", "famt_n", "rsum", "rn", "hr"]
        rows = [(t, *[got[f"{n}_{i}"] for n in names]) for i, t in enumerate(groups) if got[f"n_{i}"]]
        schema = "transaction_type string, n long, nf long, amt decimal(38,2), amt_n long, famt decimal(38,2), famt_n long, rsum decimal(38,4), rn long, hr long"
        return _of_types(df.sparkSession.createDataFrame(rows, schema))

    return df.observe(seen, *measures, other), finished


def _of_types(per_type: DataFrame) -> DataFrame:
    """A1 from its measures per transaction type."""
    typed = F.col("transaction_type").isNotNull()
    return per_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_transactions"),
        F.coalesce(F.sum("nf"), F.lit(0)).cast("long").alias("total_fraud"),
        F.coalesce(F.try_divide(F.sum("nf").cast("double"), F.sum("n")), F.lit(0.0)).alias("fraud_rate"),
        F.map_from_entries(F.collect_list(F.when(typed, F.struct("transaction_type", "n")))).alias(
            "transaction_types"
        ),
        F.map_from_entries(
            F.collect_list(F.when(typed & (F.col("nf") > 0), F.struct("transaction_type", "nf")))
        ).alias("fraud_by_type"),
        F.try_divide(F.sum("amt").cast("double"), F.sum("amt_n")).alias("avg_amount"),
        F.try_divide(F.sum("famt").cast("double"), F.sum("famt_n")).alias("fraud_amount"),
        F.try_divide(F.sum("rsum").cast("double"), F.sum("rn")).alias("avg_risk_score"),
        F.coalesce(F.sum("hr"), F.lit(0)).cast("long").alias("high_risk_transactions"),
    )


def fraud_metrics_flat(df: DataFrame) -> DataFrame:
    """A1 with the two maps rendered as ``TYPE:n`` text, for comparison."""
    m = fraud_metrics(df)
    return m.withColumns(
        {"transaction_types": _map_text(F.col("transaction_types")), "fraud_by_type": _map_text(F.col("fraud_by_type"))}
    )


# --- A2-A10 ------------------------------------------------------------------------------------------


def summary(df: DataFrame) -> DataFrame:
    """A2: totals, fraud rate in percent and money rounded half-even to 2 places; avg fraud amount 0 if none."""
    fraud = F.col("is_fraud")
    agg = df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(fraud).alias("total_fraud"),
        F.sum("amount").alias("vol"),
        exact_mean(F.col("amount")).alias("avg"),
        F.sum(F.when(fraud, F.col("amount"))).alias("fvol"),
        exact_mean(F.when(fraud, F.col("amount"))).alias("favg"),
    )
    n, nf = F.col("total_transactions"), F.col("total_fraud")
    return agg.select(
        n,
        nf,
        F.bround(F.coalesce(F.try_divide(nf.cast("double"), n), F.lit(0.0)) * 100, 2).alias("fraud_rate"),
        F.bround(F.coalesce(F.col("vol").cast("double"), F.lit(0.0)), 2).alias("total_volume"),
        F.bround(F.col("avg"), 2).alias("avg_amount"),
        F.bround(F.coalesce(F.col("fvol").cast("double"), F.lit(0.0)), 2).alias("fraud_amount"),
        F.bround(F.when(nf > 0, F.col("favg")).otherwise(F.lit(0.0)), 2).alias("avg_fraud_amount"),
    )


def transactions_by_step(df: DataFrame) -> DataFrame:
    """A3."""
    return df.groupBy("time_step").agg(F.count(F.lit(1)).alias("transaction_count"))


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """A4: value_counts semantics: nulls dropped, most frequent first, ties by key (O2)."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.desc(name), F.asc(column))
    )


def type_distribution(df: DataFrame) -> DataFrame:
    """A4 over transaction_type."""
    return value_counts(df, "transaction_type", "transaction_count")


def amount_distribution(df: DataFrame) -> DataFrame:
    """A5: counts per amount category; categories with no rows appear with 0 (4-row label table joined)."""
    spark = df.sparkSession
    labels = spark.createDataFrame([(c, i) for i, c in enumerate(S.AMOUNT_CATEGORIES)], "amount_category string, rank int")
    counts = (
        df.select(X.amount_category(F.col("amount")).alias("amount_category"))
        .where(F.col("amount_category").isNotNull())
        .groupBy("amount_category")
        .agg(F.count(F.lit(1)).alias("transaction_count"))
    )
    return (
        F.broadcast(labels)
        .join(counts, "amount_category", "left")
        .select("amount_category", F.coalesce("transaction_count", F.lit(0)).cast("long").alias("transaction_count"), "rank")
        .orderBy(F.desc("transaction_count"), "rank")
        .drop("rank")
    )


def fraud_by_type(df: DataFrame) -> DataFrame:
    """A6."""
    return value_counts(df.where(F.col("is_fraud")), "transaction_type", "fraud_count")


def fraud_amount_stats(df: DataFrame) -> DataFrame:
    """Sum (0 when there is no fraud), mean, max, min of fraud amounts."""
    a = F.when(F.col("is_fraud"), F.col("amount"))
    return df.agg(
        F.coalesce(F.sum(a).cast("double"), F.lit(0.0)).alias("total_fraud_amount"),
        exact_mean(a).alias("avg_fraud_amount"),
        F.max(a).cast("double").alias("max_fraud_amount"),
        F.min(a).cast("double").alias("min_fraud_amount"),
    )


def fraud_by_step(df: DataFrame) -> DataFrame:
    """A8."""
    return df.where(F.col("is_fraud")).groupBy("time_step").agg(F.count(F.lit(1)).alias("fraud_count"))


def detection_stats(df: DataFrame) -> DataFrame:
    """Flagged / fraud (not an intersection, so it can pass 1); 0 when there is no fraud."""
    agg = df.agg(
        F.count_if(F.col("is_fraud")).alias("total_fraud"),
        F.count_if(F.col("is_flagged_fraud")).alias("flagged_fraud"),
    )
    return agg.withColumn(
        "detection_rate",
        F.when(F.col("total_fraud") > 0, F.col("flagged_fraud") / F.col("total_fraud")).otherwise(F.lit(0.0)),
    )


# grouping_id of the bundle's four grouping sets over (transaction_type, time_step, amount_category)
_BY_TYPE, _BY_STEP, _BY_CATEGORY, _TOTAL = 3, 5, 6, 7


def bundle_aggregate(df: DataFrame) -> DataFrame:
    """A10: every number of the bundle in one pass: one aggregate with four grouping sets over narrow rows."""
    keys = ["transaction_type", "time_step", "amount_category"]
    rows = df.select("transaction_type", "time_step", X.amount_category(F.col("amount")).alias("amount_category"), "amount", "is_fraud", "is_flagged_fraud")
    fraud = F.when(F.col("is_fraud"), F.col("amount"))
    return rows.groupingSets([["transaction_type"], ["time_step"], ["amount_category"], []], *keys).agg(
        F.grouping_id().cast("int").alias("grouping"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_fraud")).alias("fraud_n"),
        F.count_if(F.col("is_flagged_fraud")).alias("flagged_n"), F.sum("amount").alias("volume"), F.count("amount").alias("amount_n"),
        F.sum(fraud).alias("fraud_volume"), F.count(fraud).alias("fraud_amount_n"), F.max(fraud).alias("fraud_max"), F.min(fraud).alias("fraud_min"),
    )


def analytics_bundle(df: DataFrame, *, store: str | None = None) -> dict[str, DataFrame]:
    """A10: the read-path bundle. ``df`` is read once: its grouping sets (a row per type, step and category) are written to
    ``store``, or the work folder, and the nine frames are read off them."""
    spark = df.sparkSession
    path = store or work_path(spark, "bundle", unique=True)
    sets = bundle_aggregate(df)
    sets.write.mode("overwrite").parquet(path)
    sets = spark.read.schema(sets.schema).parquet(path)
    of = lambda kind: sets.where(F.col("grouping") == kind)
    money = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    mean = lambda c, n: F.try_divide(F.sum(c).cast("double"), F.sum(n))
    total, fraud_n = of(_TOTAL), count("fraud_n")

    def ranked(kind: int, key: str, value: str, name: str) -> DataFrame:
        return of(kind).where(F.col(key).isNotNull() & (F.col(value) > 0)).select(key, F.col(value).alias(name)).orderBy(F.desc(name), F.asc(key))

    labels = F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(S.AMOUNT_CATEGORIES)], "amount_category string, rank int"))
    return {
        "summary": total.agg(
            count("n").alias("total_transactions"), fraud_n.alias("total_fraud"),
            F.bround(F.coalesce(F.try_divide(fraud_n.cast("double"), count("n")), F.lit(0.0)) * 100, 2).alias("fraud_rate"),
            F.bround(money("volume"), 2).alias("total_volume"), F.bround(mean("volume", "amount_n"), 2).alias("avg_amount"),
            F.bround(money("fraud_volume"), 2).alias("fraud_amount"),
            F.bround(F.when(fraud_n > 0, mean("fraud_volume", "fraud_amount_n")).otherwise(F.lit(0.0)), 2).alias("avg_fraud_amount")),
        "transaction_types": ranked(_BY_TYPE, "transaction_type", "n", "transaction_count"),
        "transactions_by_step": of(_BY_STEP).select("time_step", F.col("n").alias("transaction_count")),
        "amount_distribution": labels.join(of(_BY_CATEGORY), "amount_category", "left")
        .select("amount_category", F.coalesce("n", F.lit(0)).cast("long").alias("transaction_count"), "rank").orderBy(F.desc("transaction_count"), "rank").drop("rank"),
        "fraud_by_type": ranked(_BY_TYPE, "transaction_type", "fraud_n", "fraud_count"),
        "fraud_amount_stats": total.agg(
            money("fraud_volume").alias("total_fraud_amount"), mean("fraud_volume", "fraud_amount_n").alias("avg_fraud_amount"),
            F.max("fraud_max").cast("double").alias("max_fraud_amount"), F.min("fraud_min").cast("double").alias("min_fraud_amount")),
        "fraud_by_step": of(_BY_STEP).where("fraud_n > 0").select("time_step", F.col("fraud_n").alias("fraud_count")),
        "fraud_statistics": total.agg(
            fraud_n.alias("total_fraud"), count("flagged_n").alias("flagged_fraud"),
            F.when(fraud_n > 0, count("flagged_n") / fraud_n).otherwise(F.lit(0.0)).alias("detection_rate")),
        "generated_at": spark.range(1).select(F.current_timestamp().alias("timestamp")),
    }


def bundle_rows(bundle: dict[str, DataFrame]) -> DataFrame:
    """The bundle in long form: (metric, item, value); one-row frames give a row per column."""
    out = None
    for name, frame in bundle.items():
        if name == "generated_at":
            continue
        first, *rest = frame.columns
        if len(rest) == 1:
            long = frame.select(F.lit(name).alias("metric"), F.col(first).cast("string").alias("item"), F.col(rest[0]).cast("double").alias("value"))
        else:
            long = frame.select(*[F.col(c).cast("double").alias(c) for c in frame.columns]).unpivot([], frame.columns, "item", "value").select(F.lit(name).alias("metric"), "item", "value")
        out = long if out is None else out.unionByName(long)
    return out


# --- A11-A17 -----------------------------------------------------------------------------------------


def hourly_volume(df: DataFrame) -> DataFrame:
    """sum(amount) by step mod 24 (floor modulo)."""
    return df.groupBy(X.floor_mod(F.col("time_step"), 24).cast("int").alias("hour")).agg(
        F.sum("amount").cast("double").alias("volume")
    )


def daily_volume(df: DataFrame) -> DataFrame:
    """sum(amount) by step div 24 (floor division)."""
    return df.groupBy(X.floor_div(F.col("time_step"), 24).cast("int").alias("day")).agg(
        F.sum("amount").cast("double").alias("volume")
    )


def dashboard_metrics(df: DataFrame, *, p95: float | None = None) -> DataFrame:
    """A13 + A14: one row. ``unusual_patterns`` counts amounts above the exact 95th percentile;
    ``high_risk_transactions`` adds the fraud, high-value and top-5% counts (rows in two sets count twice)."""
    if p95 is None:
        p95 = exact_percentiles(df, "amount", [0.95])[0.95]
    amount = F.col("amount")
    ratio = X.balance_change_ratio(F.col("sender_new_balance"), F.col("sender_old_balance"))
    agg = df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("is_fraud")).alias("total_fraud"),
        F.sum(amount).cast("double").alias("total_volume"),
        exact_mean(amount).alias("avg_amount"),
        F.count_if(amount > S.HIGH_VALUE_THRESHOLD).alias("high_value_transactions"),
        F.count_if(amount.cast("double") > F.lit(p95)).alias("unusual_patterns"),
        F.count_if(X.gt_not_nan(ratio, S.RATIO_THRESHOLD)).alias("balance_changes"),
    )
    return agg.select(
        "total_transactions",
        "total_fraud",
        (F.try_divide(F.col("total_fraud").cast("double"), F.col("total_transactions")) * F.lit(100.0)).alias(
            "fraud_rate"
        ),
        "total_volume",
        "avg_amount",
        "high_value_transactions",
        "unusual_patterns",
        "balance_changes",
        (F.col("total_fraud") + F.col("high_value_transactions") + F.col("unusual_patterns")).alias(
            "high_risk_transactions"
        ),
    )


def percentile_lines(df: DataFrame, probs=(0.95, 0.99)) -> DataFrame:
    """Exact, interpolated 95th and 99th percentiles of amount, one row."""
    vals = exact_percentiles(df, "amount", list(probs))
    names = [f"p{int(round(p * 100))}" for p in probs]
    return df.sparkSession.range(1).select(*[F.lit(vals[p]).cast("double").alias(n) for p, n in zip(probs, names)])


def type_totals_vs_fraud(df: DataFrame) -> DataFrame:
    """Total and fraud count per type in one pass."""
    return df.groupBy("transaction_type").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.count_if(F.col("is_fraud")).alias("fraud_count")
    )


def daily_report(df: DataFrame, day: str, *, generated_at: Column | None = None) -> DataFrame:
    """One row for one date even when the day is empty; nulls become 0."""
    start = F.to_timestamp_ntz(F.lit(f"{day} 00:00:00"))
    ts = F.col("transaction_date")
    day_rows = df.where((ts >= start) & (ts < start + F.expr("INTERVAL 1 DAY")))
    agg = day_rows.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("amount").alias("vol"),
        risk_mean(F.col("risk_score")).alias("avg_risk"),
        F.count_if(F.col("risk_score") > S.DAILY_HIGH_RISK).alias("high_risk_count"),
    )
    return agg.select(
        F.to_date(F.lit(day)).alias("date"),
        "total_transactions",
        F.coalesce(F.col("vol").cast("double"), F.lit(0.0)).alias("total_volume"),
        F.coalesce("avg_risk", F.lit(0.0)).alias("avg_risk_score"),
        "high_risk_count",
        (generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
    )


# --- A23, A24 ----------------------------------------------------------------------------------------


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One aggregate of null counts, unpivoted to (column_name, null_count)."""
    cols = columns or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def job_result(metrics: DataFrame, *, status: str = "success", run_date: str) -> DataFrame:
    """The job's result row, read off the metrics row (no extra pass over the data)."""
    return metrics.select(
        F.lit(status).alias("status"),
        F.to_date(F.lit(run_date)).alias("date"),
        F.col("total_transactions").alias("transactions_processed"),
        F.col("total_fraud").alias("fraud_alerts_processed"),
        F.to_json(F.struct(*[F.col(c) for c in metrics.columns])).alias("metrics"),
        F.lit(datetime.now().isoformat()).alias("finished_at"),
    )
