"""T4 in the state store and in one micro-batch: late duplicates, keys without a good message, expiry, and the plan."""

import datetime as dt
import os

from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.sources.topics import read_topic_files
from ledgerflow.streaming import consumer

HOUR = 3600 * 1000


def message(key, offset, hour, good=True):
    body = '{"time_step": 1, "transaction_type": "PAYMENT", %s"sender_id": "A%d", "receiver_id": "B"}' % ('"amount": 1, ' if good else "", offset)
    return (key, body, "t", 0, offset, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour))


def run(spark, tmp_dir, batches, hours, restart_after=None):
    """Statuses by offset of batches of messages, one file each; with a restart after some of them."""
    for part in ([batches] if restart_after is None else [batches[:restart_after], batches[restart_after:]]):
        for rows in part:
            spark.createDataFrame(rows, S.TOPIC_MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/topic")
        q = consumer.start_transaction_stream(
            read_topic_files(spark, f"{tmp_dir}/topic", max_files_per_trigger=1), f"{tmp_dir}/store", f"{tmp_dir}/ckpt",
            state_ttl_ms=hours * HOUR, statuses=True, event_time=True)
        q.awaitTermination(600)
        assert q.exception() is None
    got = spark.read.parquet(f"{tmp_dir}/store/statuses").collect()
    return {r.offset: r.status for r in got}


def test_duplicates_and_bad_messages_over_batches_and_a_restart(spark, tmp_dir):
    batches = [
        [message("a", 0, 0, good=False), message("a", 1, 0), message("a", 2, 0), message("b", 3, 0, good=False)],
        [message("a", 4, 1, good=False), message("b", 5, 1, good=False), message("c", 6, 5)],
        # late duplicate of a and late first of d (both behind the watermark), b becomes good
        [message("a", 7, 0), message("d", 8, 0), message("b", 9, 5), message("b", 10, 5, good=False)],
        [message("b", 11, 5, good=False), message("d", 12, 5, good=False), message("c", 13, 5)],
    ]
    got = run(spark, tmp_dir, batches, hours=100, restart_after=2)
    assert got == {0: "invalid", 1: "success", 2: "duplicate", 3: "invalid", 4: "duplicate", 5: "invalid", 6: "success", 7: "duplicate", 8: "success",
                   9: "success", 10: "duplicate", 11: "duplicate", 12: "duplicate", 13: "duplicate"}


def test_late_first_messages_are_kept_and_old_keys_forgotten(spark, tmp_dir):
    batches = [
        [message("a", 0, 0), message("x", 1, 50)],
        [message("y", 2, 51)],  # the watermark passes a
        [message("late", 3, 1), message("y", 4, 51), message("a", 5, 52)],  # 3: late and never seen, 5: a is forgotten
    ]
    got = run(spark, tmp_dir, batches, hours=10)
    assert got == {0: "success", 1: "success", 2: "success", 3: "success", 4: "duplicate", 5: "success"}


def test_no_python_in_the_plan(spark, tmp_dir):
    import inspect

    from ledgerflow.streaming import dedup

    assert not any(word in inspect.getsource(dedup) for word in ("Pandas", "udf", "mapInArrow"))
    rows = spark.createDataFrame([message("a", 0, 0)], S.TOPIC_MESSAGE)
    narrow = consumer.decode_messages(rows, carry=["value"]).select("message_key", "offset", "status", "value", F.col("message_timestamp").alias("seen_at"))
    tagged = narrow.withColumn("kind", F.lit("row"))
    out = dedup.batch_statuses(tagged, "seen_at", F.current_timestamp(), spark.createDataFrame([], "message_key string, seen_at timestamp"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_state_partitions_follow_the_topic_not_the_session(spark, tmp_dir):
    import os

    from ledgerflow.plans import job_queries

    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "64")
    try:
        spark.createDataFrame([message("a", 0, 0), message("a", 1, 0), message("b", 2, 0, good=False)], S.TOPIC_MESSAGE).coalesce(1).write.parquet(f"{tmp_dir}/topic")
        n = job_queries._state_partitions(spark, f"{tmp_dir}/topic")
        q = consumer.start_transaction_stream(
            read_topic_files(spark, f"{tmp_dir}/topic"), f"{tmp_dir}/store", f"{tmp_dir}/ckpt", state_ttl_ms=HOUR, statuses=True, event_time=True, state_partitions=n)
        q.awaitTermination(600)
        assert spark.conf.get(name) == "64"
    finally:
        spark.conf.set(name, before)
    assert n == job_queries.LEAST_STATES == len([x for x in os.listdir(f"{tmp_dir}/ckpt/state/0") if x.isdigit()])
    assert {r.offset: r.status for r in spark.read.parquet(f"{tmp_dir}/store/statuses").collect()} == {0: "success", 1: "duplicate", 2: "invalid"}


def test_a_filter_on_the_status_doesn_t_parse_again(spark):
    from ledgerflow.streaming.decode import decode_messages

    rows = spark.createDataFrame([message("a", 0, 0), message("a", 1, 0, good=False), ("b", "no json", "t", 0, 2, None)], S.TOPIC_MESSAGE)
    good = decode_messages(rows).where("status = 'ok'")
    assert [r.offset for r in good.collect()] == [0]
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("get_json_object") == 1


def test_one_file_is_decoded_in_several_tasks_and_state_is_asked_once(spark, tmp_dir):
    rows = [message(f"k{i % 40}", i, 0, good=i % 5 > 0) for i in range(100)]
    spark.createDataFrame(rows, S.TOPIC_MESSAGE).coalesce(1).write.parquet(f"{tmp_dir}/topic")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.unset(provider)  # as in a session that isn't get_session's
    try:
        there = spark.conf.get(provider)
        q = consumer.start_transaction_stream(read_topic_files(spark, f"{tmp_dir}/topic"), f"{tmp_dir}/store", f"{tmp_dir}/ckpt", state_ttl_ms=HOUR, statuses=True, event_time=True)
        q.awaitTermination(600)
        assert spark.conf.get(provider) == there
    finally:
        spark.conf.set(provider, before)
    plan = q._jsq.explainInternal(False)
    assert "ReusedExchange" in plan and plan.index("Generate inline") < plan.index("hashpartitioning(coalesce") < plan.index("FileScan")
    state = q.lastProgress["stateOperators"][0]
    # the operators of the stream ran once: each of the good messages' keys was put into the state once
    assert state["numRowsTotal"] == state["numRowsUpdated"] == 32 and state["customMetrics"]["rocksdbPutCount"] == 32
    assert not [n for n in os.listdir(f"{tmp_dir}/store") if n.startswith("keys")]
    first = {}
    want = {}
    for i in range(100):
        k, good = i % 40, i % 5 > 0
        want[i] = "duplicate" if k in first else "success" if good else "invalid"
        if good:
            first.setdefault(k, i)
    assert {r.offset: r.status for r in spark.read.parquet(f"{tmp_dir}/store/statuses").collect()} == want


def test_what_is_remembered_is_looked_up_without_a_shuffle(spark, tmp_dir):
    from ledgerflow.streaming import dedup

    rows = spark.createDataFrame([message("a", 5, 1, good=False), message("b", 6, 1, good=False), message("c", 7, 1)], S.TOPIC_MESSAGE)
    batch = consumer.decode_messages(rows).select("message_key", "offset", "status", F.col("message_timestamp").alias("seen_at")).withColumn("kind", F.lit("row"))
    batch = batch.unionByName(batch.where("message_key = 'c'").withColumn("kind", F.lit("new")))
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "message_key string, seen_at timestamp").write.parquet(f"{tmp_dir}/old")
    old = spark.read.parquet(f"{tmp_dir}/old")
    horizon = F.lit("2023-01-01").cast("timestamp")
    statuses = []
    for few in (False, True):
        out = dedup.batch_statuses(batch, "seen_at", horizon, old, few=few)
        statuses.append({r.message_key: r.status for r in out.collect()})
    assert statuses == [{"a": "duplicate", "b": "invalid", "c": "success"}] * 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
