"""Payment and alert layouts, risk metrics over both, alert generation and the joins between them.

Skew: the per-sender windows (velocity, first payment to a receiver) never put a sender's raw rows into
one window partition. Rows are first aggregated per (sender, time_step) or (sender, receiver) with a
map-side combine; a sender that holds a third of all rows then has one row per distinct hour, which is
bounded by the time range, not by the data volume. The per-key results are joined back on their key
(AQE's skew-join split handles a hot key on the large side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.functions import features as X

# ------------------------------------------------------------------------------------------------
# Payment layout
# ------------------------------------------------------------------------------------------------

# status -> status_category; anything else is "other"
STATUS_CATEGORY = {"completed": "successful", "failed": "failed", "fraudulent": "fraudulent"}


def status_category(status: Column) -> Column:
    """P21."""
    expr = None
    for k, v in STATUS_CATEGORY.items():
        expr = F.when(status == k, F.lit(v)) if expr is None else expr.when(status == k, F.lit(v))
    return expr.otherwise(F.lit("other"))


def rates_table(spark, rates: dict[str, float] | None = None) -> DataFrame:
    rates = rates or S.DEFAULT_RATES
    return spark.createDataFrame(sorted(rates.items()), "currency string, usd_rate double")


def transform_payments(df: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """P21-P25 on the payment layout.

    amount_usd = amount × rate of the row's currency; an unknown currency gives null. The rates table is a
    parameter with one row per currency; a repeated currency is an error, not a repeated payment.
    """
    rates = rates if rates is not None else rates_table(df.sparkSession)
    twice = F.raise_error(F.concat(F.lit("more than one rate for "), F.col("currency")))
    rates = rates.groupBy("currency").agg(F.count(F.lit(1)).alias("_n"), F.first("usd_rate").alias("usd_rate")).select(
        "currency", F.when(F.col("_n") == 1, F.col("usd_rate")).otherwise(twice.cast("double")).alias("usd_rate")
    )
    ts = F.col("created_at")
    out = df.join(rates, "currency", "left")
    return out.select(
        *df.columns,
        F.to_date(ts).alias("transaction_date"),
        F.hour(ts).cast("int").alias("transaction_hour"),
        X.day_name(ts).alias("transaction_day_of_week"),
        status_category(F.col("status")).alias("status_category"),
        X.amount_category(F.col("amount")).alias("amount_category"),
        (F.col("amount") * F.col("usd_rate")).alias("amount_usd"),
        X.is_high_value(F.col("amount")).alias("is_high_value"),
    )


# ------------------------------------------------------------------------------------------------
# Alert layout
# ------------------------------------------------------------------------------------------------

# alert risk bins: (.., 0.5] low, (0.5, 0.9] medium, (0.9, ..) high
ALERT_RISK_BINS = [(0.5, "low"), (0.9, "medium")]
ALERT_RISK_TOP = "high"
# alert priority by status
STATUS_PRIORITY = {"open": "high", "investigating": "medium"}
PRIORITY_DEFAULT = "low"


def alert_risk_category(score: Column) -> Column:
    """P27."""
    expr = F.when(score.isNull() | F.isnan(score), F.lit(None).cast("string"))
    for edge, label in ALERT_RISK_BINS:
        expr = expr.when(score <= edge, F.lit(label))
    return expr.otherwise(F.lit(ALERT_RISK_TOP))


def alert_priority(status: Column) -> Column:
    """By workflow status (open -> high, investigating -> medium, else low)."""
    expr = None
    for k, v in STATUS_PRIORITY.items():
        expr = F.when(status == k, F.lit(v)) if expr is None else expr.when(status == k, F.lit(v))
    return expr.otherwise(F.lit(PRIORITY_DEFAULT))


def transform_alerts(df: DataFrame) -> DataFrame:
    """alert_date, alert_hour, risk_category, alert_priority, amount_category."""
    ts = F.col("created_at")
    return df.withColumns(
        {
            "alert_date": F.to_date(ts),
            "alert_hour": F.hour(ts).cast("int"),
            "risk_category": alert_risk_category(F.col("risk_score")),
            "alert_priority": alert_priority(F.col("status")),
            "amount_category": X.amount_category(F.col("amount")),
        }
    )


# ------------------------------------------------------------------------------------------------
# Risk metrics over transactions + alerts
# ------------------------------------------------------------------------------------------------


# exact accumulators: money at 6 and scores at 6 decimal places, so sums do not depend on row order
MONEY_SUM = "decimal(24,6)"
SCORE_SUM = "decimal(20,6)"


def risk_metrics(transactions: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row from two global aggregates (one row each, so the cross join is 1×1).

    fraud_rate = alerts / transactions; high_value_fraud_rate = alerts above 10000 / transactions above
    10000, 0 when there are none.
    """
    hv = S.HIGH_VALUE_THRESHOLD
    t = transactions.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(F.col("amount").cast(MONEY_SUM)).alias("_vol"),
        F.count("amount").alias("_n_amount"),
        F.count_if(F.col("amount") > hv).alias("_hv_transactions"),
    )
    a = alerts.agg(
        F.count(F.lit(1)).alias("total_fraud_alerts"),
        F.sum(F.col("risk_score").cast(SCORE_SUM)).alias("_risk_sum"),
        F.count("risk_score").alias("_risk_n"),
        F.count_if(F.col("amount") > hv).alias("_hv_alerts"),
    )
    j = t.crossJoin(F.broadcast(a))  # 1 row × 1 row: two global aggregates
    return j.select(
        "total_transactions",
        F.coalesce(F.col("_vol").cast("double"), F.lit(0.0)).alias("total_volume"),
        F.try_divide(F.col("_vol").cast("double"), F.col("_n_amount")).alias("avg_transaction"),
        "total_fraud_alerts",
        F.coalesce(F.try_divide(F.col("total_fraud_alerts").cast("double"), F.col("total_transactions")), F.lit(0.0)).alias(
            "fraud_rate"
        ),
        F.try_divide(F.col("_risk_sum").cast("double"), F.col("_risk_n")).alias("avg_risk_score"),
        F.coalesce(F.try_divide(F.col("_hv_alerts").cast("double"), F.col("_hv_transactions")), F.lit(0.0)).alias(
            "high_value_fraud_rate"
        ),
    )


def payment_method_fraud_rates(transactions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per payment_method, alerts ÷ transactions (two grouped counts, left join on the method)."""
    t = transactions.groupBy("payment_method").agg(F.count(F.lit(1)).alias("transactions"))
    a = alerts.groupBy("payment_method").agg(F.count(F.lit(1)).alias("alerts"))
    return t.join(a, "payment_method", "left").select(
        "payment_method",
        "transactions",
        F.coalesce("alerts", F.lit(0)).alias("alerts"),
        (F.coalesce("alerts", F.lit(0)) / F.col("transactions")).alias("fraud_rate"),
    )


def payment_method_fraud_rate_map(transactions: DataFrame, alerts: DataFrame) -> DataFrame:
    """A22 as the reference's dict: one row with a map method -> rate (size = number of methods)."""
    r = payment_method_fraud_rates(transactions, alerts)
    return r.agg(
        F.map_from_entries(F.collect_list(F.struct("payment_method", "fraud_rate"))).alias("payment_method_fraud_rates")
    )


# ------------------------------------------------------------------------------------------------
# Joins (J1, J2, J5) and paging
# ------------------------------------------------------------------------------------------------


def alerts_with_transaction(alerts: DataFrame, transactions: DataFrame, tx_key: str = "id") -> DataFrame:
    """Every alert with its transaction's columns (many-to-one, left). The strategy (broadcast or
    sort-merge) is left to Catalyst's size estimate and AQE's runtime sizes."""
    tx = transactions.select([F.col(c).alias(f"tx_{c}") for c in transactions.columns])
    return alerts.join(tx, alerts["transaction_id"] == tx[f"tx_{tx_key}"], "left")


def orphan_alerts(alerts: DataFrame, transactions: DataFrame, tx_key: str = "id") -> DataFrame:
    """Alerts whose transaction does not exist (foreign-key breach)."""
    return alerts.join(
        transactions.select(F.col(tx_key).alias("_tx_key")), alerts["transaction_id"] == F.col("_tx_key"), "left_anti"
    )


def apply_patch(base: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Partial update by key; a non-null patch field replaces the base field, null leaves it."""
    fields = [c for c in patch.columns if c != key and c in base.columns]
    p = patch.select(key, *[F.col(c).alias(f"_patch_{c}") for c in fields])
    j = base.join(p, key, "left")
    return j.select(
        *[
            F.coalesce(F.col(f"_patch_{c}"), F.col(c)).cast(base.schema[c].dataType).alias(c) if c in fields else F.col(c)
            for c in base.columns
        ]
    )


def page(df: DataFrame, order_by: list[str], page_no: int, size: int) -> DataFrame:
    """O3: one page of rows in key order (plans as TakeOrderedAndProject: a top-k per task, no full sort)."""
    if page_no < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return df.orderBy(*order_by).offset((page_no - 1) * size).limit(size)


def page_envelope(df: DataFrame, order_by: list[str], page_no: int, size: int) -> DataFrame:
    """O3 with the list-response fields: total, page, size beside each row."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = page(df, order_by, page_no, size)
    return rows.crossJoin(F.broadcast(total)).withColumns({"page": F.lit(page_no), "size": F.lit(size)})


def head_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first n rows by an explicit key (files have no row order in Spark)."""
    return df.orderBy(*order_by).limit(n)


# ------------------------------------------------------------------------------------------------
# Windows (W3, W4) and alert generation (F1)
# ------------------------------------------------------------------------------------------------

VELOCITY_HOURS = 24
VELOCITY_MIN_COUNT = 3


def _pair_steps(df: DataFrame) -> DataFrame:
    """Rows per (sender, receiver, time_step): the one map-side-combined aggregate both windows start from."""
    return df.groupBy("sender_id", "receiver_id", "time_step").agg(F.count(F.lit(1)).alias("_n"))


def _velocity_table(per_step: DataFrame, hours: int) -> DataFrame:
    """Sender velocity per (sender, step) from row counts keyed by (sender, step)."""
    w = Window.partitionBy("sender_id").orderBy("time_step").rangeBetween(-hours, 0)
    return per_step.select("sender_id", "time_step", F.sum("_n").over(w).alias("sender_velocity"))


def _first_table(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("sender_id", "receiver_id").agg(F.min("time_step").alias("_first_step"))


def _step_counts(df: DataFrame) -> DataFrame:
    """Rows per (sender, time_step), map-side combined."""
    return df.groupBy("sender_id", "time_step").agg(F.count(F.lit(1)).alias("_n"))


def with_velocity(df: DataFrame, hours: int = VELOCITY_HOURS, min_count: int = VELOCITY_MIN_COUNT) -> DataFrame:
    """``sender_velocity`` = the sender's transactions with time_step in [t - hours, t] (ties included),
    ``velocity_check`` = sender_velocity ≥ min_count."""
    vel = _velocity_table(_step_counts(df), hours)
    return _null_safe_left(df, vel, ["sender_id", "time_step"]).withColumn(
        "velocity_check", F.col("sender_velocity") >= min_count
    )


def _null_safe_left(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which null keys are equal, as they are to a window and an aggregate."""
    right = other.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [df[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return df.join(right, on, "left").drop(*[f"_r_{k}" for k in keys])


def with_first_payment(df: DataFrame) -> DataFrame:
    """``first_to_receiver`` — the row is at the earliest time step of its (sender, receiver) pair."""
    return _with_first(df, _first_table(_pair_steps(df)))


def _with_first(df: DataFrame, first: DataFrame) -> DataFrame:
    return (
        _null_safe_left(df, first, ["sender_id", "receiver_id"])
        .withColumn("first_to_receiver", F.coalesce(F.col("time_step") == F.col("_first_step"), F.lit(False)))
        .drop("_first_step")
    )


def with_velocity_and_first(df: DataFrame, hours: int = VELOCITY_HOURS, min_count: int = VELOCITY_MIN_COUNT) -> DataFrame:
    """W3 and W4 together. Each (sender, receiver, step) gets the pair's first step by a window over the pair, in which a row
    is one distinct step, and the velocity of its (sender, step) by a join; the result is joined back to the rows once, on
    the three keys. So the aggregated keys are shuffled four times, the velocities three and the rows once."""
    first = F.min("time_step").over(Window.partitionBy("sender_id", "receiver_id"))
    pairs = df.select("sender_id", "receiver_id", "time_step").distinct().withColumn("_first_step", first)
    per_pair_step = _null_safe_left(pairs, _velocity_table(_step_counts(df), hours), ["sender_id", "time_step"]).select(
        "sender_id",
        "receiver_id",
        "time_step",
        "sender_velocity",
        (F.col("sender_velocity") >= min_count).alias("velocity_check"),
        F.coalesce(F.col("time_step") == F.col("_first_step"), F.lit(False)).alias("first_to_receiver"),
    )
    return _null_safe_left(df, per_pair_step, ["sender_id", "receiver_id", "time_step"])


ALERT_RULES = ["suspicious_amount", "unusual_pattern", "velocity_check", "new_merchant"]


def _fired(scored: DataFrame) -> DataFrame:
    """One row per (transaction, rule that fires): the transaction's columns and alert_type."""
    # the ratio is read here, before the rows are shuffled, so that it needn't go with them
    pattern = X.gt_not_nan(F.col("balance_change_ratio"), S.RATIO_THRESHOLD) & X.gt_not_nan(F.col("risk_score"), 0.5)
    df = with_velocity_and_first(scored.withColumn("_pattern", pattern))
    rules = F.array_compact(
        F.array(
            F.when(F.col("unusual_amount"), F.lit("suspicious_amount")),
            F.when(F.col("_pattern"), F.lit("unusual_pattern")),
            F.when(F.col("velocity_check"), F.lit("velocity_check")),
            F.when(F.col("first_to_receiver") & F.col("high_value_transaction"), F.lit("new_merchant")),
        )
    )
    return df.withColumn("alert_type", F.explode(rules)).drop("_pattern")


def generate_alerts(scored: DataFrame) -> DataFrame:
    """one alert per (transaction, rule that fires), status open.

    suspicious_amount: unusual_amount; unusual_pattern: balance ratio > 0.5 and risk_score > 0.5;
    velocity_check: W3; new_merchant: first payment to the receiver (W4) of a high-value amount.
    """
    return _fired(scored).select(
        "time_step",
        "sender_id",
        "receiver_id",
        F.col("amount").cast("double").alias("amount"),
        "risk_score",
        "alert_type",
        F.lit("open").alias("status"),
    )


# what a transaction's id is made of
ID_COLUMNS = ["time_step", "transaction_type", "amount", "sender_id", "receiver_id", "sender_old_balance", "receiver_old_balance"]


def _id(*parts: Column) -> Column:
    """60 bits of the digest of the parts' texts (null: empty): the same in every run, on every partition."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def with_transaction_id(df: DataFrame) -> DataFrame:
    """Transactions with an ``id`` made of their content; rows equal in ID_COLUMNS share it."""
    return df.withColumn("id", _id(*[F.col(c) for c in ID_COLUMNS]))


def alert_rows(scored: DataFrame) -> DataFrame:
    """F1 in the alert table's layout, for J1, J2, Q9 and the insert of alerts: an id made of the transaction's and the rule, so
    that a repeated run makes the same rows; created_at is the transaction's time."""
    fired = with_transaction_id(_fired(scored)).withColumnRenamed("id", "transaction_id")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return fired.select(
        _id(F.col("transaction_id"), F.col("alert_type")).alias("id"),
        "transaction_id",
        "alert_type",
        F.lit("open").alias("status"),
        "risk_score",
        F.col("amount").cast("double").alias("amount"),
        F.col("transaction_type").alias("payment_method"),
        F.concat(F.col("alert_type"), F.lit(": "), known("transaction_type"), F.lit(" of "), known("amount"), F.lit(" from "), known("sender_id"), F.lit(" to "), known("receiver_id")).alias("description"),
        F.col("transaction_date").alias("created_at"),
    )
