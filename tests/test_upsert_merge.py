"""The store's merge of base and changes: no shuffle of the base, null keys, growth of the buckets, uncommitted bases."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow import schemas as S
from ledgerflow.sources.files import remove_path
from ledgerflow.streaming import upsert


def successes(spark, rows):
    """(time_step, sender, receiver, amount, offset) as successful messages."""
    df = spark.createDataFrame(rows, "time_step int, sender_id string, receiver_id string, amount decimal(18,2), offset long")
    rest = [f for f in S.STORED_TRANSACTION.fields if f.name in S.UPSERT_FIELDS and f.name != "amount"]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in rest})


def at(n):
    return F.timestamp_seconds(F.lit(1_700_000_000 + n))


def stored(spark, root):
    rows = upsert.read_table(spark, root).selectExpr(*S.UPSERT_KEY, "amount", "unix_seconds(cast(created_at as timestamp)) - 1700000000 a", "unix_seconds(cast(updated_at as timestamp)) - 1700000000 b").collect()
    out = {tuple(r[:3]): (float(r.amount), r.a, r.b) for r in rows}
    assert len(out) == len(rows)
    return out


def test_random_batches_and_compactions(spark, tmp_dir):
    rng, root, want, offset = random.Random(5), f"{tmp_dir}/store", {}, 0
    for batch in range(9):
        rows = []
        for _ in range(rng.choice([0, 1, 40])):
            key = (rng.randrange(3), rng.choice(["A", "B", None]), rng.choice(["X", "Y", "Z", None]))
            rows.append((*key, rng.randrange(100), offset))
            offset += 1
        last = {r[:3]: float(r[3]) for r in rows}
        typed = [(t, a, b, Decimal(m), o) for t, a, b, m, o in rows]
        upsert.upsert_batch(successes(spark, typed), root, batch, now=at(batch))
        for k, amount in last.items():
            want[k] = (amount, want[k][1] if k in want else batch, batch)
        assert stored(spark, root) == want
        if batch % 3 == 1:  # the buckets grow with each of them
            assert upsert.compact(spark, root, bucket_bytes=20_000 // (batch + 1)) == batch
            assert stored(spark, root) == want
    remove = [n for n in os.listdir(f"{root}/base/upto=7") if n.startswith(upsert.MARKER)]
    assert len(remove) == 1 and int(remove[0][len(upsert.MARKER):]) > 4
    remove_path(spark, f"{root}/base/upto=7/{remove[0]}")  # as if the compaction had ended before its marker
    assert stored(spark, root) == want and upsert.compact(spark, root) == 8 and stored(spark, root) == want


@pytest.mark.parametrize("partitions", ["2", "64"])
def test_the_base_is_not_shuffled(spark, tmp_dir, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check_plan(spark, tmp_dir)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def check_plan(spark, tmp_dir):
    root = f"{tmp_dir}/store"
    upsert.upsert_batch(successes(spark, [(i, f"A{i}", "B", Decimal(i), i) for i in range(500)]), root, 0)
    upsert.compact(spark, root, bucket_bytes=1500)
    upsert.upsert_batch(successes(spark, [(3, "A3", "B", Decimal(7), 900), (900, "A9", "B", Decimal(8), 901)]), root, 1)
    current, _, buckets, _ = upsert._current(spark, root)
    assert buckets >= 8
    plan = current._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :].split("Union")[0]
    sides = join.split("FileScan parquet")
    assert "upto=0" in sides[1] and "Exchange" not in sides[0] and f"SelectedBucketsCount: {buckets} out of {buckets}" in sides[1]
    assert "batch=1" in sides[2] and "Exchange hashpartitioning" in sides[1]
    # one file a bucket at most, also when the base is written anew from base and changes
    upsert.compact(spark, root, bucket_bytes=1500)
    files = [n for n in os.listdir(f"{root}/base/upto=1") if n.startswith("part-")]
    assert len(files) <= max(buckets, int([n for n in os.listdir(f"{root}/base/upto=1") if n.startswith(upsert.MARKER)][0][len(upsert.MARKER):]))
    assert upsert.read_table(spark, root).count() == 501


def test_a_large_base_is_compacted_in_many_tasks(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/store"
    upsert.upsert_batch(successes(spark, [(i, f"A{i}", "B", Decimal(i), i) for i in range(200)]), root, 0)
    want = stored(spark, root)
    monkeypatch.setattr(upsert, "stored_bytes", lambda *_: 250 << 20)
    assert upsert.compact(spark, root) == 0
    assert upsert._read_base(spark, f"{root}/base/upto=0")[1] == 8 and stored(spark, root) == want
