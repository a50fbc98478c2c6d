"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator of the inventory.

Every query reads the generated tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators import alerts as AL
from ledgerflow.operators import marts, metrics, quality
from ledgerflow.functions.features import add_time_columns
from ledgerflow.operators.enrich import canonical_transactions, enrich_transactions, process_transactions
from ledgerflow.session import work_path
from ledgerflow.sources import fixtures
from ledgerflow.streaming import consumer, upsert
from ledgerflow.streaming.decode import decode_messages

Query = Callable[[SparkSession, str], DataFrame]


def transaction_date_from(step, epoch: str):
    """Epoch + ``step`` hours as TIMESTAMP_NTZ."""
    return F.to_timestamp_ntz(F.lit(epoch)) + F.make_dt_interval(hours=step)


def stored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions, joined once and stored in the work folder: for queries that pass over them more than once."""
    rows = fixtures.transactions(spark, sf_dir)
    path = work_path(spark, "transactions", unique=True)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def scored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows; the percentile and the projection both read the stored transactions."""
    return enrich_transactions(stored_transactions(spark, sf_dir))


def daily_transaction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.daily_transaction_summary(scored_transactions(spark, sf_dir))


MONEY_COLUMNS = ["amount", "sender_old_balance", "sender_new_balance", "receiver_old_balance", "receiver_new_balance"]


def _money_as_double(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in MONEY_COLUMNS if c in df.columns})


def _on_scored(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(scored_transactions(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def timed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with their time columns: no percentile is computed for queries that don't read one."""
    return add_time_columns(canonical_transactions(fixtures.transactions(spark, sf_dir)))


def _on_timed(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(timed_transactions(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money_as_double(scored_transactions(spark, sf_dir))


def processed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money_as_double(process_transactions(scored_transactions(spark, sf_dir))).drop("processed_at")


def staging_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.staging(scored_transactions(spark, sf_dir)).select(
        "time_step", "transaction_type", "sender_id", "receiver_id", "transaction_date",
        "is_amount_null", "is_risk_score_invalid", "is_transaction_date_null",
    )


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dashboard_metrics(stored_transactions(spark, sf_dir))


def percentile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentile_lines(fixtures.transactions(spark, sf_dir))


def daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.daily_report(scored_transactions(spark, sf_dir), "2018-06-15").drop("generated_at")


def payment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.transform_payments(fixtures.payments(spark, sf_dir))


def alert_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.transform_alerts(fixtures.alerts(spark, sf_dir))


def risk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.risk_metrics(fixtures.payments(spark, sf_dir), fixtures.alerts(spark, sf_dir))


def payment_method_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.payment_method_fraud_rates(fixtures.payments(spark, sf_dir), fixtures.alerts(spark, sf_dir))


def alerts_with_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.alerts_with_transaction(fixtures.alerts(spark, sf_dir), fixtures.payments(spark, sf_dir))


def orphan_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.orphan_alerts(fixtures.alerts(spark, sf_dir), fixtures.payments(spark, sf_dir))


def patched_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fixtures.alerts(spark, sf_dir)
    patch = base.where(F.pmod("id", F.lit(14)) == 0).select(
        "id",
        F.lit("resolved").alias("status"),
        F.lit(None).cast("double").alias("risk_score"),
        F.when(F.pmod("id", F.lit(28)) == 0, F.col("amount") * 2).alias("amount"),
    )
    return AL.apply_patch(base, patch)


def alert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.page_envelope(fixtures.alerts(spark, sf_dir), ["id"], 3, 50)


def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.with_velocity(stored_transactions(spark, sf_dir)).select(
        "time_step", "sender_id", "receiver_id", "sender_velocity", "velocity_check"
    )


def first_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.with_first_payment(stored_transactions(spark, sf_dir)).select(
        "time_step", "sender_id", "receiver_id", "first_to_receiver"
    )


def generated_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.generate_alerts(scored_transactions(spark, sf_dir))


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AL.alert_rows(scored_transactions(spark, sf_dir))


def alert_table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9 on F1's own alerts, their transactions looked up by id."""
    scored = scored_transactions(spark, sf_dir)
    alerts = AL.alert_rows(scored)
    path = work_path(spark, "alerts", unique=True)
    alerts.write.parquet(path)
    return quality.alert_quality(spark.read.schema(alerts.schema).parquet(path), AL.with_transaction_id(scored).select("id"))


def transaction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.transaction_quality(scored_transactions(spark, sf_dir))


def payment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.payment_quality(fixtures.payments(spark, sf_dir))


def alert_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.alert_quality(fixtures.alerts(spark, sf_dir), fixtures.payments(spark, sf_dir))


def payment_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.completeness(fixtures.payments(spark, sf_dir))


def message_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumer.process_messages(fixtures.topic_messages(spark, sf_dir)).select(
        "message_key", "offset", "partition", "status"
    )


def stream_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumer.status_counts(consumer.process_messages(fixtures.topic_messages(spark, sf_dir)))


def upserted_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money_as_double(upsert.upsert_all(consumer.process_messages(fixtures.topic_messages(spark, sf_dir))))


def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    # processed: the messages that were stored; later ones of a partition were duplicates or not valid
    msgs = fixtures.topic_messages(spark, sf_dir)
    processed = consumer.process_messages(msgs).where("status = 'success'")
    return consumer.consumer_lag(processed, consumer.end_offsets_of(msgs))


def delay_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode_messages(fixtures.topic_messages(spark, sf_dir))
    step_start = transaction_date_from(F.col("time_step"), "2024-01-01 00:00:00")
    delay = F.unix_micros(F.col("message_timestamp")).cast("double") / 1e6 - F.unix_micros(
        step_start.cast("timestamp")
    ).cast("double") / 1e6
    return consumer.delay_histogram(d, delay, [60.0, 600.0, 3600.0, 21600.0, 86400.0])


def fraud_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerflow.operators.enrich import fraud_rows as fr

    return _money_as_double(fr(scored_transactions(spark, sf_dir))).select("time_step", "sender_id", "receiver_id", "amount", "risk_score")


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerflow.operators.enrich import flagged_rows as fl

    return _money_as_double(fl(fixtures.transactions(spark, sf_dir))).select("time_step", "sender_id", "receiver_id", "amount", "is_fraud")


def rows_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerflow.operators.enrich import rows_of_step_day

    # the day as a range of time steps: computed from line items alone, so other days never reach the joins
    day = add_time_columns(rows_of_step_day(fixtures.transactions(spark, sf_dir), "2019-03-01"))
    return _money_as_double(day).select(
        "time_step", "transaction_type", "sender_id", "receiver_id", "amount", "transaction_date"
    )


def hover_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerflow.functions.features import hover_label

    return fixtures.transactions(spark, sf_dir).select(
        "time_step", "sender_id", "receiver_id", hover_label(F.col("transaction_type"), F.col("amount")).alias("label")
    )


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the row cap is the operator itself (the reference reads the first 10,000 rows of its file)
    return _money_as_double(
        AL.head_rows(fixtures.transactions(spark, sf_dir), 10_000, ["time_step", "sender_id", "receiver_id"])
    )


def latest_message_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerflow.streaming.dedup import latest_per_key

    d = decode_messages(fixtures.topic_messages(spark, sf_dir)).select(
        "time_step", "sender_id", "receiver_id", "offset", "status"
    )
    return latest_per_key(d, ["time_step", "sender_id", "receiver_id"])


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerflow.sources.topics import to_events

    events = to_events(fixtures.alerts(spark, sf_dir), "fraud_alert_created", sent_at=F.col("created_at"))
    data = "id long, transaction_id long, risk_score double, alert_type string, status string, amount double, payment_method string"
    back = F.from_json("value", f"event_type string, timestamp string, data struct<{data.replace(' ', ':').replace(',:', ',')}>")
    return events.select("key", "topic", back.alias("e")).select("key", "topic", "e.event_type", "e.timestamp", "e.data.*")


QUERIES: dict[str, Query] = {
    "p9_scored_transactions": scored_table,
    "p15_processed_transactions": processed_table,
    "p16_staging_flags": staging_flags,
    "a1_fraud_metrics": _on_scored(metrics.fraud_metrics_flat),
    "a2_summary": _on_timed(metrics.summary),
    "a3_transactions_by_step": _on_timed(metrics.transactions_by_step),
    "a4_type_distribution": _on_timed(metrics.type_distribution),
    "a5_amount_distribution": _on_timed(metrics.amount_distribution),
    "a6_fraud_by_type": _on_timed(metrics.fraud_by_type),
    "a7_fraud_amount_stats": _on_timed(metrics.fraud_amount_stats),
    "a8_fraud_by_step": _on_timed(metrics.fraud_by_step),
    "a9_detection_stats": _on_timed(metrics.detection_stats),
    "a11_hourly_volume": _on_timed(metrics.hourly_volume),
    "a12_daily_volume": _on_timed(metrics.daily_volume),
    "a13_dashboard_metrics": dashboard,
    "a15_percentile_lines": percentile_lines,
    "a16_type_totals_vs_fraud": _on_timed(metrics.type_totals_vs_fraud),
    "a17_daily_report": daily_report,
    "a20_daily_transaction_summary": daily_transaction_summary,
    "a23_null_counts": _on_scored(metrics.null_counts),
    "p21_p25_payment_features": payment_features,
    "p26_p28_alert_features": alert_features,
    "a21_risk_metrics": risk_metrics,
    "a22_payment_method_fraud_rates": payment_method_rates,
    "j1_alerts_with_transaction": alerts_with_transaction,
    "j2_orphan_alerts": orphan_alerts,
    "j5_patched_alerts": patched_alerts,
    "o3_alert_page": alert_page,
    "w3_velocity": velocity,
    "w4_first_payment": first_payment,
    "f1_generated_alerts": generated_alerts,
    "f1_alert_table": alert_table,
    "f1_alert_checks": alert_table_checks,
    "q_transaction_checks": transaction_checks,
    "q_payment_checks": payment_checks,
    "q_alert_checks": alert_checks,
    "q7_payment_completeness": payment_completeness,
    "t3_t4_message_status": message_status,
    "t6_status_counts": stream_status_counts,
    "j4_upserted_transactions": upserted_transactions,
    "t7_consumer_lag": consumer_lag,
    "t8_delay_histogram": delay_histogram,
    "p17_fraud_rows": fraud_rows,
    "p18_flagged_rows": flagged_rows,
    "p19_rows_of_day": rows_of_day,
    "p32_hover_labels": hover_labels,
    "s2_head_rows": head_rows,
    "w2_latest_message_per_key": latest_message_per_key,
    "t9_alert_events": alert_events,
}
