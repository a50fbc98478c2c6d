"""The transaction stream job (T1) with its counters (T6), lag (T7) and delay histogram.

source (Kafka or files) -> dealt by message key -> decode/classify (T2, T3) -> keyed de-duplication in the state store (T4)
-> foreachBatch: status counts + upsert of the successes (T5). Progress and state live in the query's
checkpoint folder, so a restart resumes where the last committed batch ended; the upsert is idempotent
per batch id, which makes the sink effectively-once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.sources.files import list_names, remove_path
from ledgerflow.sources.topics import message_key
from ledgerflow.streaming.decode import decode_messages
from ledgerflow.streaming.dedup import batch_keys, batch_statuses, dedup_batch, unsure_keys, with_new_keys
from ledgerflow.streaming.upsert import upsert_batch

STATUSES = ["success", "duplicate", "invalid", "error"]
FEW_KEYS = 500_000  # keys of a micro-batch that are looked up by sending them to the executors; more are shuffled
_STORE = "spark.sql.streaming.stateStore."
#: The keys' state lies on the executors' disks, with a bound on the memory of all partitions together.
STATE_SETTINGS = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}rocksdb.maxMemoryUsageMB": "200",
}


def status_counts(messages_final: DataFrame) -> DataFrame:
    """Messages per final status; all four statuses appear (0 when absent)."""
    wide = messages_final.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    rows = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("messages")) for s in STATUSES])
    return wide.select(F.inline(rows))


def consumer_lag(processed: DataFrame, end_offsets: DataFrame) -> DataFrame:
    """Per topic partition, end offset − offset of the last processed message (1 at the head, as the
    end offset is one past the last message). Partitions with nothing processed lag by end offset − 0."""
    done = processed.groupBy("topic", "partition").agg(F.max("offset").alias("last_offset"))
    return end_offsets.join(done, ["topic", "partition"], "left").select(
        "topic",
        "partition",
        (F.col("end_offset") - F.coalesce("last_offset", F.lit(0))).alias("lag"),
    )


def end_offsets_of(messages: DataFrame) -> DataFrame:
    """End offsets of a topic held as a table: last offset + 1 per partition."""
    return messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def delay_histogram(df: DataFrame, delay: Column, edges: list[float]) -> DataFrame:
    """Cumulative bucket counts (``le`` = upper edge, count of delays ≤ edge), one aggregate."""
    wide = df.agg(*[F.count_if(delay <= F.lit(e)).alias(f"b{i}") for i, e in enumerate(edges)])
    arr = F.array(*[F.struct(F.lit(float(e)).alias("le"), F.col(f"b{i}").alias("count")) for i, e in enumerate(edges)])
    return wide.select(F.explode(arr).alias("b")).select("b.le", "b.count")


def process_messages(messages: DataFrame) -> DataFrame:
    """Batch twin of T1-T4: every message with its final status."""
    return dedup_batch(decode_messages(messages))


def _latest_time(spark: SparkSession, store_root: str) -> datetime | None:
    """The latest time of a good message in the batches counted so far."""
    counted = _counted(spark, store_root)
    return counted.agg(F.max("latest")).first()[0] if counted is not None else None


def _counted(spark: SparkSession, store_root: str) -> DataFrame | None:
    if not list_names(spark, f"{store_root}/status_counts"):
        return None
    return spark.read.schema("status string, messages long, latest timestamp, batch int").parquet(f"{store_root}/status_counts")


def _remembered(spark: SparkSession, store_root: str, batch_id: int) -> DataFrame:
    """First good messages of earlier batches: (message_key, seen_at)."""
    done = [n for n in list_names(spark, f"{store_root}/first_good") if n.startswith("batch=") and int(n[6:]) < batch_id]
    if not done:
        return _none_remembered(spark)
    return spark.read.schema("message_key string, seen_at timestamp").parquet(*[f"{store_root}/first_good/{n}" for n in done])


def _none_remembered(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit(None).cast("string").alias("message_key"), F.lit(None).cast("timestamp").alias("seen_at"))


def start_transaction_stream(
    source: DataFrame,
    store_root: str,
    checkpoint: str,
    *,
    state_ttl_ms: int,
    available_now: bool = True,
    processing_time: str | None = None,
    now: Column | None = None,
    statuses: bool = False,
    event_time: bool = False,
    state_partitions: int | None = None,
):
    """Start the stream job; returns the StreamingQuery. ``state_ttl_ms`` is how long a key is remembered, by the time of
    arrival, or with ``event_time`` by the messages' own timestamps; the source bounds a micro-batch
    (``max_offsets_per_trigger``, ``max_files_per_trigger``).

    Every micro-batch has a task and a state file per state partition, and its own shuffles have as many tasks, however few
    its messages are. ``state_partitions`` is that number (default: the session's shuffle partitions); a checkpoint keeps
    the one that it was started with. So it does the state's store, which is RocksDB for a new one (``STATE_SETTINGS``).

    The source's messages are dealt out by their key before they are decoded, as a file of a micro-batch may be read by one
    task. Per micro-batch: the batch is persisted once and every message gets its final status (``dedup.batch_statuses``); first
    good messages, status counts and the upsert of the successes are written under the batch's id, so a replay
    changes nothing; with ``statuses`` every message's final status is kept as well. Only the key and time of good messages
    pass through the state; the decoded fields go with the batch. Nothing of it leaves the JVM.
    """
    spark = source.sparkSession
    seen_at = F.col("message_timestamp") if event_time else F.current_timestamp()
    dealt = source.repartition(message_key(*map(F.col, ("key", "topic", "partition", "offset"))))
    decoded = decode_messages(dealt).select(
        "message_key", F.col("offset").alias("offset"), "status", seen_at.alias("seen_at"), *S.UPSERT_KEY, *S.UPSERT_FIELDS)
    tagged = with_new_keys(decoded, "seen_at", state_ttl_ms)
    remember = F.expr(f"INTERVAL {int(state_ttl_ms) // 1000} SECOND")
    latest_before = {"time": _latest_time(spark, store_root)}

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        final, own = None, f"{store_root}/keys-{batch_id}"
        try:
            # stored for the batch's time: a plan that has the batch twice may run the stream's operators a second time
            keys = batch_keys(batch, "seen_at")
            keys.write.mode("overwrite").parquet(own)
            keys = spark.read.schema(keys.schema).parquet(own)
            latest = keys.agg(F.max("_latest")).first()[0]
            latest = max([t for t in (latest, latest_before["time"]) if t is not None], default=None)
            horizon = F.lit(latest).cast("timestamp") - remember
            asked = unsure_keys(keys, horizon).limit(FEW_KEYS + 1).count()
            remembered = _remembered(spark, store_root, batch_id) if asked else _none_remembered(spark)
            final = batch_statuses(batch, "seen_at", horizon, remembered, keys=keys, few=asked <= FEW_KEYS).persist()
            success = final.where(F.col("status") == "success")
            success.select("message_key", "seen_at").write.mode("overwrite").parquet(f"{store_root}/first_good/batch={batch_id}")
            if statuses:
                final.select("message_key", "offset", "status").write.mode("overwrite").parquet(f"{store_root}/statuses/batch={batch_id}")
            upsert_batch(success, store_root, batch_id, now=now)
            (
                status_counts(final)
                .withColumns({"latest": F.lit(latest).cast("timestamp"), "batch": F.lit(batch_id)})
                .coalesce(1)
                .write.mode("overwrite")
                .parquet(f"{store_root}/status_counts/batch={batch_id}")
            )
            latest_before["time"] = latest
        finally:
            batch.unpersist()
            if final is not None:
                final.unpersist()
            remove_path(spark, own)

    w = tagged.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    # the state's tasks stand alone, where the state of their partition lies; put together with those of the decoded messages
    # they would run wherever these came from, and load it anew in each micro-batch
    settings = STATE_SETTINGS | {"spark.sql.unionOutputPartitioning": "false"}
    if state_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(int(state_partitions))
    if processing_time or not available_now:
        w = w.trigger(processingTime=processing_time) if processing_time else w
    else:
        # a moving watermark asks for batches without data; a run over what is there has none
        w, settings["spark.sql.streaming.noDataMicroBatches.enabled"] = w.trigger(availableNow=True), "false"
    conf = spark.conf
    before = {name: conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            conf.set(name, value)
        return w.start()  # the query keeps the settings that it starts with
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def lag_from_progress(progress: dict) -> list[dict]:
    """T7 live: per topic partition, the source's latest offset minus the offset the query has reached,
    read from ``StreamingQuery.lastProgress`` (Kafka sources report both as {topic: {partition: offset}})."""
    rows = []
    for src in (progress or {}).get("sources", []):
        latest, reached = src.get("latestOffset"), src.get("endOffset")
        if not isinstance(latest, dict) or not isinstance(reached, dict):
            continue
        for topic, parts in latest.items():
            for part, end in parts.items():
                done = reached.get(topic, {}).get(part, 0)
                rows.append({"topic": topic, "partition": int(part), "lag": int(end) - int(done)})
    return rows
