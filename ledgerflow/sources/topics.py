"""Topic sources and sinks.

The Kafka connector is used when its package is on the classpath (``format("kafka")``). Everything after
the source works on the connector's columns ``key, value, topic, partition, offset, timestamp``, so a file
source with that schema (``read_topic_files``) drives the same job in tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow import schemas as S

# Fixed topic names and event types of the producer.
TOPIC_PREFIX = "fintech-"
EVENTS = {
    "transaction_created": ("transactions", "id"),
    "fraud_alert_created": ("fraud-alerts", "id"),
    "user_updated": ("users", "id"),
    "merchant_updated": ("merchants", "id"),
    "risk_score_updated": ("risk-scores", "user_id"),
    "compliance_report_generated": ("compliance", "id"),
}
UNKNOWN_KEY = "unknown"
TOPIC_COLUMNS = ["key", "value", "topic", "partition", "offset", "timestamp"]


def read_topic(spark: SparkSession, bootstrap_servers: str, topic: str, *, starting_offsets: str = "earliest",
               max_offsets_per_trigger: int, **options: str) -> DataFrame:
    """A streaming read of one topic from the earliest offset, key and value as text. Progress lives
    in the query's checkpoint (replaces the consumer's auto-commit). A micro-batch takes at most
    ``max_offsets_per_trigger`` messages. Offsets that the broker no longer has fail the query; a caller
    who accepts the loss says so (``failOnDataLoss="false"``)."""
    r = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    )
    for k, v in options.items():
        r = r.option(k, v)
    return r.load().select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
        "timestamp",
    )


def read_topic_files(spark: SparkSession, path: str, *, fmt: str = "parquet", max_files_per_trigger: int = 100) -> DataFrame:
    """The same message columns from files (a stand-in source where no broker is reachable), at most
    ``max_files_per_trigger`` files in a micro-batch."""
    r = spark.readStream.schema(S.TOPIC_MESSAGE).format(fmt).option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def message_key(key: Column, topic: Column, partition: Column, offset: Column) -> Column:
    """P35 on read: the message key, or ``topic-partition-offset`` when it is null or empty. Unlike a random uuid
    it is the same on a replay, and never equal to another message's."""
    return F.coalesce(F.nullif(key, F.lit("")), F.concat_ws("-", topic, partition.cast("string"), offset.cast("string")))


def event_key(df: DataFrame, key_col: str | None) -> Column:
    """P35 on write: the key column as text, ``unknown`` when absent or null; an empty text is no key."""
    if key_col and key_col in df.columns:
        return F.nullif(F.coalesce(F.col(key_col).cast("string"), F.lit(UNKNOWN_KEY)), F.lit(""))
    return F.lit(UNKNOWN_KEY)


def to_events(df: DataFrame, event_type: str, key_col: str | None = None, *, sent_at: Column | None = None) -> DataFrame:
    """One envelope per row, ``{"event_type", "timestamp", "data": {row}}``, with its key and topic.
    Null fields stay in the data as nulls, as a consumer tells null from absent."""
    topic, default_key = EVENTS.get(event_type, (event_type, "id"))
    ts = sent_at if sent_at is not None else F.current_timestamp()
    envelope = F.struct(
        F.lit(event_type).alias("event_type"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.struct(*[F.col(c) for c in df.columns]).alias("data"),
    )
    return df.select(
        event_key(df, key_col or default_key).alias("key"),
        F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"),
        F.lit(TOPIC_PREFIX + topic).alias("topic"),
    )


def write_topic(events: DataFrame, bootstrap_servers: str, *, checkpoint: str | None = None):
    """Write ``key, value, topic`` rows to the broker (batch, or a stream when ``events`` is one)."""
    out = events.select("key", "value", "topic")
    if out.isStreaming:
        return (
            out.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers)
            .option("checkpointLocation", checkpoint)
            .start()
        )
    out.write.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).save()
    return None
