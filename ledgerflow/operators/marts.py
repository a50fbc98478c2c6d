"""Staging view and the daily transaction summary mart.

Sums and means are computed from exact DECIMAL sums (order-independent) and cast to double only at the
end, so the result does not depend on partitioning or on the engine: ``avg = double(sum) / count``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow import schemas as S

STAGING_COLUMNS = [
    "time_step",
    "amount",
    "sender_id",
    "receiver_id",
    "transaction_date",
    "transaction_type",
    "risk_score",
    "sender_old_balance",
    "sender_new_balance",
    "receiver_old_balance",
    "receiver_new_balance",
    "is_fraud",
    "is_flagged_fraud",
    "transaction_hour",
    "transaction_day",
    "amount_category",
    "high_value_transaction",
    "unusual_amount",
    "balance_change_ratio",
]

# exact accumulator for risk scores: multiples of 0.1 carried as doubles (e.g. 1.2000000000000002)
RISK_SUM_TYPE = "decimal(20,4)"


def staging(df: DataFrame) -> DataFrame:
    """The 19 staged columns plus three quality flags."""
    risk = F.col("risk_score")
    return df.select(
        *STAGING_COLUMNS,
        F.col("amount").isNull().alias("is_amount_null"),
        F.coalesce((risk < 0) | (risk > 1), F.lit(False)).alias("is_risk_score_invalid"),
        F.col("transaction_date").isNull().alias("is_transaction_date_null"),
    )


def _ratio(num, den):
    return F.try_divide(num.cast("double"), den)


def daily_stats_partials(stg: DataFrame) -> DataFrame:
    """Per (date, type) aggregates with the exact partial sums the ALL row needs."""
    risk = F.col("risk_score")
    return stg.groupBy(F.to_date("transaction_date").alias("date"), "transaction_type").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("_volume"),
        F.count("amount").alias("_amount_n"),
        F.sum(risk.cast(RISK_SUM_TYPE)).alias("_risk_sum"),
        F.count(risk).alias("_risk_n"),
        F.count_if(risk > S.DAILY_HIGH_RISK).alias("high_risk_count"),
        F.count_if(risk > S.DAILY_CRITICAL_RISK).alias("critical_risk_count"),
        F.countDistinct("sender_id").alias("unique_senders"),
        F.countDistinct("receiver_id").alias("unique_receivers"),
    )


MART_COLUMNS = [
    "date",
    "transaction_type",
    "transaction_count",
    "total_volume",
    "avg_amount",
    "avg_risk_score",
    "high_risk_count",
    "critical_risk_count",
    "unique_senders",
    "unique_receivers",
]


# A19, the 'ALL' row per date: avg_amount = total volume / all rows, so rows with a null amount count in the divisor;
# avg_risk_score is the mean of the per-type means, each weighted by all rows of its type; unique_senders and
# unique_receivers are the maximum over types, not a distinct count over the day. That is the mart's definition.


def daily_transaction_summary(enriched: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Per-type rows ∪ ALL rows, ordered by date, type.

    The data is aggregated once (A18 partials, one row per date and type). Each partial row is then
    emitted twice, under its own type and under 'ALL', and a second, small aggregate per (date, type)
    produces both kinds of rows: over a single row sum and max are the identity, over a date's types
    they give the A19 values. A ``union`` of the two stages would plan the data aggregate twice.
    """
    partials = daily_stats_partials(staging(enriched))
    # a type's mean times all its rows; with no null risk that is the exact sum
    mean_by_rows = F.when(F.col("_risk_n") == F.col("transaction_count"), F.col("_risk_sum").cast("decimal(30,12)")).otherwise(
        (F.col("_risk_sum").cast("double") / F.nullif(F.col("_risk_n"), F.lit(0)) * F.col("transaction_count")).cast("decimal(30,12)")
    )
    # the flag is part of the key: a type that is itself called ALL stays apart from the total
    doubled = partials.withColumn("_risk_all", mean_by_rows).withColumn("_is_all", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "transaction_type", F.when(F.col("_is_all"), F.lit("ALL")).otherwise(F.col("transaction_type"))
    )
    g = doubled.groupBy("date", "transaction_type", "_is_all").agg(
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("_volume").alias("_volume"),
        F.sum("_amount_n").alias("_amount_n"),
        F.sum("_risk_sum").alias("_risk_sum"),
        F.sum("_risk_n").alias("_risk_n"),
        F.sum("_risk_all").alias("_risk_all"),
        F.sum("high_risk_count").alias("high_risk_count"),
        F.sum("critical_risk_count").alias("critical_risk_count"),
        F.max("unique_senders").alias("unique_senders"),
        F.max("unique_receivers").alias("unique_receivers"),
    )
    divisor = F.when(F.col("_is_all"), F.col("transaction_count")).otherwise(F.col("_amount_n"))
    out = g.select(
        "date",
        "transaction_type",
        F.col("transaction_count").cast("long").alias("transaction_count"),
        F.col("_volume").cast("double").alias("total_volume"),
        _ratio(F.col("_volume"), divisor).alias("avg_amount"),
        F.when(F.col("_is_all"), _ratio(F.col("_risk_all"), F.col("transaction_count")))
        .otherwise(_ratio(F.col("_risk_sum"), F.col("_risk_n")))
        .alias("avg_risk_score"),
        F.col("high_risk_count").cast("long").alias("high_risk_count"),
        F.col("critical_risk_count").cast("long").alias("critical_risk_count"),
        "unique_senders",
        "unique_receivers",
    )
    return out.orderBy("date", "transaction_type") if ordered else out
