"""The stream job on a file source of topic messages equals the batch twin, in one batch or many,
and resumes from its checkpoint; the upsert is idempotent per batch id."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.sources import fixtures
from ledgerflow.sources.topics import read_topic_files, to_events
from ledgerflow.streaming import consumer, upsert

from conftest import SF_SMALL

KEY = S.UPSERT_KEY
DAY = 24 * 3600 * 1000
VALUE_COLS = KEY + S.UPSERT_FIELDS


def _write_chunks(spark, msgs, path, n_chunks):
    # offsets in order across files, so file order = offset order (as a topic partition delivers them)
    ranked = msgs.withColumn("_chunk", F.ntile(n_chunks).over(__import__("pyspark.sql").sql.Window.orderBy("offset")))
    for i in range(1, n_chunks + 1):
        ranked.where(F.col("_chunk") == i).drop("_chunk").coalesce(1).write.mode("append").parquet(path)


def _table(spark, root):
    return upsert.read_table(spark, root).select(*VALUE_COLS)


def _expected(spark, msgs):
    return upsert.upsert_all(consumer.process_messages(msgs)).select(*VALUE_COLS)


def _same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_stream_equals_batch_in_several_batches(spark, tmp_dir):
    msgs = fixtures.topic_messages(spark, SF_SMALL)
    src = f"{tmp_dir}/topic"
    _write_chunks(spark, msgs, src, 3)
    q = consumer.start_transaction_stream(
        read_topic_files(spark, src, max_files_per_trigger=1), f"{tmp_dir}/store", f"{tmp_dir}/ckpt", state_ttl_ms=DAY
    )
    q.awaitTermination(600)
    assert q.exception() is None
    assert _same(_table(spark, f"{tmp_dir}/store"), _expected(spark, msgs))
    counts = spark.read.parquet(f"{tmp_dir}/store/status_counts").groupBy("status").agg(F.sum("messages").alias("n"))
    twin = consumer.status_counts(consumer.process_messages(msgs))
    assert _same(counts, twin)
    assert spark.read.parquet(f"{tmp_dir}/store/status_counts").select("batch").distinct().count() == 3


def test_restart_from_checkpoint_and_idempotent_batch(spark, tmp_dir):
    msgs = fixtures.topic_messages(spark, SF_SMALL).orderBy("offset")
    half = msgs.agg(F.percentile_approx("offset", 0.5)).first()[0]
    src, store, ckpt = f"{tmp_dir}/topic", f"{tmp_dir}/store", f"{tmp_dir}/ckpt"
    msgs.where(F.col("offset") <= half).coalesce(1).write.parquet(src)
    q = consumer.start_transaction_stream(read_topic_files(spark, src), store, ckpt, state_ttl_ms=DAY)
    q.awaitTermination(600)
    first_part = msgs.where(F.col("offset") <= half)
    assert _same(_table(spark, store), _expected(spark, first_part))
    # new messages arrive; the restarted query picks up only those, with the state of the first run
    msgs.where(F.col("offset") > half).coalesce(1).write.mode("append").parquet(src)
    q = consumer.start_transaction_stream(read_topic_files(spark, src), store, ckpt, state_ttl_ms=DAY)
    q.awaitTermination(600)
    assert _same(_table(spark, store), _expected(spark, msgs))
    # replaying an already committed batch id leaves the table unchanged
    before = _table(spark, store)
    snapshot = sorted(map(tuple, before.collect()))
    last = max(int(n.split("=")[1]) for n in os.listdir(f"{store}/changes") if "=" in n)
    succ = consumer.process_messages(msgs).where("status = 'success'")
    assert upsert.upsert_batch(succ, store, last) is False
    assert sorted(map(tuple, _table(spark, store).collect())) == snapshot


def test_envelope_encode_decode_round_trip(spark):
    tx = spark.createDataFrame(
        [(7, 1, "PAYMENT", 100.0, "C1", 1000.0, 900.0, "M1", 500.0, 600.0, False, False)],
        "id long, time_step int, transaction_type string, amount double, sender_id string, sender_old_balance double, "
        "sender_new_balance double, receiver_id string, receiver_old_balance double, receiver_new_balance double, "
        "is_fraud boolean, is_flagged_fraud boolean",
    )
    ev = to_events(tx, "transaction_created")
    r = ev.first()
    assert r["key"] == "7" and r["topic"] == "fintech-transactions"
    as_msgs = ev.select("key", "value", "topic", F.lit(0).alias("partition"), F.lit(5).cast("long").alias("offset"),
                        F.current_timestamp().alias("timestamp"))
    d = consumer.process_messages(as_msgs).first()
    assert d["status"] == "success" and d["amount"] == 100 and d["sender_id"] == "C1"
    missing = spark.createDataFrame([(None, '{"amount": 100.0, "sender_id": "C1"}', "t", 0, 1, None), (None, "not json", "t", 0, 2, None)],
                                    S.TOPIC_MESSAGE)
    got = {r["offset"]: (r["status"], r["message_key"]) for r in consumer.process_messages(missing).collect()}
    assert got == {1: ("invalid", "t-0-1"), 2: ("invalid", "t-0-2")}


def _changes(spark, offset, *rows):
    """Successful messages (time_step, sender, receiver, amount)."""
    base = consumer.process_messages(fixtures.topic_messages(spark, SF_SMALL)).where("status = 'success'").limit(1)
    out = None
    for i, (t, a, b, amount) in enumerate(rows):
        one = base.withColumns({"time_step": F.lit(t), "sender_id": F.lit(a), "receiver_id": F.lit(b), "amount": F.lit(amount).cast("decimal(18,2)"),
                                "offset": F.lit(offset + i).cast("long")})
        out = one if out is None else out.unionByName(one)
    return out


def _at(day):
    return F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")


def _rows(spark, root):
    return {(r.time_step, r.sender_id, r.receiver_id): (float(r.amount), r.created_at.day, r.updated_at.day) for r in upsert.read_table(spark, root).collect()}


def test_store_keeps_first_and_last_times_over_compaction(spark, tmp_dir):
    root = f"{tmp_dir}/store"
    assert upsert.compact(spark, root) == -1 and _rows(spark, root) == {}
    assert upsert.upsert_batch(_changes(spark, 0, (1, "A", "B", 10), (1, "A", "B", 11), (2, "A", "B", 5)), root, 0, now=_at(1))
    assert upsert.upsert_batch(_changes(spark, 9, (1, "A", "B", 12), (3, None, "B", 7)), root, 1, now=_at(2))
    want = {(1, "A", "B"): (12.0, 1, 2), (2, "A", "B"): (5.0, 1, 1), (3, None, "B"): (7.0, 2, 2)}
    assert _rows(spark, root) == want
    # a replay, before and after compaction, changes neither rows nor times
    assert upsert.upsert_batch(_changes(spark, 9, (1, "A", "B", 99)), root, 1, now=_at(5)) is False and _rows(spark, root) == want
    assert upsert.compact(spark, root) == 1 and _rows(spark, root) == want
    assert os.listdir(f"{root}/changes") == [] and [n for n in os.listdir(f"{root}/base") if "=" in n] == ["upto=1"]
    assert upsert.upsert_batch(_changes(spark, 9, (1, "A", "B", 99)), root, 1, now=_at(5)) is False
    assert upsert.upsert_batch(_changes(spark, 20, (1, "A", "B", 13)), root, 2, now=_at(3))
    assert _rows(spark, root) == want | {(1, "A", "B"): (13.0, 1, 3)}
    assert upsert.compact(spark, root) == 2 and _rows(spark, root) == want | {(1, "A", "B"): (13.0, 1, 3)}


def test_failed_lookup_fails_the_batch_and_loses_nothing(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/store"
    upsert.upsert_batch(_changes(spark, 0, (1, "A", "B", 10), (2, "A", "B", 5)), root, 0)
    before = _rows(spark, root)

    def timeout(*_):
        raise OSError("storage timeout")

    for name in ("path_exists", "list_names"):
        with monkeypatch.context() as m:
            m.setattr(upsert, name, timeout)
            with pytest.raises(OSError):
                upsert.upsert_batch(_changes(spark, 9, (3, "A", "B", 1)), root, 1)
    assert _rows(spark, root) == before
    assert upsert.upsert_batch(_changes(spark, 9, (3, "A", "B", 1)), root, 1) and len(_rows(spark, root)) == 3


def test_uncommitted_batch_isn_t_read(spark, tmp_dir):
    root = f"{tmp_dir}/store"
    upsert.upsert_batch(_changes(spark, 0, (1, "A", "B", 10)), root, 0)
    upsert.upsert_batch(_changes(spark, 5, (1, "A", "B", 20)), root, 1)
    os.remove(f"{root}/changes/batch=1/_SUCCESS")
    assert [v[0] for v in _rows(spark, root).values()] == [10.0]


def test_empty_key_is_no_key_and_nulls_stay(spark):
    rows = [("", '{"amount": 1, "sender_id": "A", "receiver_id": "B", "time_step": %d, "transaction_type": "PAYMENT"}' % i, "t", 0, i, None) for i in range(3)]
    got = consumer.process_messages(spark.createDataFrame(rows, S.TOPIC_MESSAGE)).collect()
    assert [r.status for r in got] == ["success"] * 3 and len({r.message_key for r in got}) == 3
    event = to_events(spark.createDataFrame([(1, None)], "id long, amount double"), "transaction_created").first()
    assert '"amount":null' in event.value


def test_text_longer_than_its_column_is_an_error(spark):
    def message(offset, kind, sender):
        return (f"k{offset}", '{"amount": 1, "sender_id": "%s", "receiver_id": "B", "time_step": 1, "transaction_type": "%s"}' % (sender, kind), "t", 0, offset, None)

    rows = [message(0, "T" * 20, "é" * 32), message(1, "T" * 21, "A"), message(2, "T", "A" * 33)]
    got = consumer.process_messages(spark.createDataFrame(rows, S.TOPIC_MESSAGE)).orderBy("offset").collect()
    assert [r.status for r in got] == ["success", "error", "error"]


def test_status_counts_are_one_aggregate(spark):
    counts = consumer.status_counts(spark.range(5).select(F.when(F.col("id") < 3, "success").otherwise("error").alias("status")))
    assert {r.status: r.messages for r in counts.collect()} == {"success": 3, "duplicate": 0, "invalid": 0, "error": 2}
    assert {r.status: r.messages for r in consumer.status_counts(counts.where("false")).collect()} == dict.fromkeys(consumer.STATUSES, 0)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "LogicalRDD" not in plan


def test_topic_files_are_in_offset_order(spark, tmp_dir):
    from ledgerflow.plans import job_queries

    rows = [(None, f"v{i}", "t", i % 4, (i * 37) % 1000, None) for i in range(1000)] + [("a", "again", "t", 0, 500, None)]
    names = job_queries._topic_files(spark, spark.createDataFrame(rows, S.TOPIC_MESSAGE), f"{tmp_dir}/all", 20)
    offsets = [[r.offset for r in spark.read.parquet(f"{tmp_dir}/all/{n}").collect()] for n in names]
    assert len(offsets) == 20 and sum(offsets, []) == sorted([*range(1000), 500]) and all(20 < len(x) < 80 for x in offsets)
    assert [os.path.getmtime(f"{tmp_dir}/all/{n}") for n in names] == sorted(os.path.getmtime(f"{tmp_dir}/all/{n}") for n in names)


def test_wrapped_bodies_are_found_however_their_name_is_written(spark):
    body = '{"amount": 1, "sender_id": "A", "receiver_id": "B", "time_step": 1, "transaction_type": "PAYMENT"}'
    values = [body, '{"data": %s}' % body, "{'data': %s}" % body, '{"\\u0064ata": %s}' % body, '{"date": %s}' % body, body.replace("PAYMENT", "data"), None]
    got = consumer.process_messages(spark.createDataFrame([(None, v, "t", 0, i, None) for i, v in enumerate(values)], S.TOPIC_MESSAGE)).orderBy("offset").collect()
    assert [r.status for r in got] == ["success"] * 4 + ["invalid", "success", "invalid"]
