"""Idempotent upsert of transactions on (time_step, sender_id, receiver_id).

Without a table format that has MERGE, the stored table is a log of collapsed changes with a compacted base:

    <root>/changes/batch=<id>/   the latest row per key of that micro-batch, stamped with the batch's time
    <root>/base/upto=<id>/       all changes up to that batch, one row per key, in hash buckets of the key

A folder counts once Spark's commit marker ``_SUCCESS`` stands in it. A micro-batch writes only its own changes, so
its cost doesn't depend on how much was stored before; a batch that is already committed is not written again, so a
replay changes nothing, its times included. Reading joins the base with the latest change per key: the changes since the last
compaction are shuffled to the base's buckets, the base isn't. ``compact`` writes that join as a new base, bucket by bucket,
and removes what the base replaces; run it from time to time, apart from the stream (one writer). Only when the stored
bytes have outgrown the buckets is the base shuffled, into at least twice as many.

A folder is looked up by name in the store's file system; a failed lookup or read fails the batch, and nothing that
is stored is ever rewritten on the strength of a failed read.
Where a MERGE-capable table format is available, ``DataFrame.mergeInto`` does the same in place.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import schemas as S
from ledgerflow.sources.files import list_names, path_exists, remove_path, stored_bytes, write_marker
from ledgerflow.streaming.dedup import latest_per_key

BUCKET_BYTES = 32 << 20  # stored bytes a bucket from which a compaction takes more buckets
MARKER = "_buckets-"
TABLE_COLUMNS = [f.name for f in S.STORED_TRANSACTION.fields]
LOG_SCHEMA = T.StructType(S.STORED_TRANSACTION.fields + [T.StructField("offset", T.LongType()), T.StructField("batch", T.LongType())])


def _committed(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the committed folders ``<name>=<number>``."""
    found = [int(n.split("=", 1)[1]) for n in list_names(spark, folder) if n.startswith(f"{name}=")]
    return sorted(n for n in found if path_exists(spark, f"{folder}/{name}={n}/_SUCCESS"))


def _latest(log: DataFrame) -> DataFrame:
    """One row per key: the last change's values, the first one's created_at, the last one's updated_at."""
    values = [c for c in LOG_SCHEMA.names if c not in S.UPSERT_KEY and c not in ("created_at", "updated_at")]
    order = F.struct("batch", "offset")
    return (
        log.groupBy(*S.UPSERT_KEY)
        .agg(F.max_by(F.struct(*values), order).alias("_row"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
        .select(*S.UPSERT_KEY, "_row.*", "created_at", "updated_at")
    )


def _write_base(rows: DataFrame, path: str, buckets: int) -> None:
    """Write a base in hash buckets of the key; the marker of their number comes last, and a base without it is read as plain
    files. The table's entry in the session's catalog is needed for the write only."""
    spark, name = rows.sparkSession, f"ledgerflow_base_{uuid.uuid4().hex}"
    remove_path(spark, path)  # of a write that wasn't committed
    rows.select(*LOG_SCHEMA.names).write.bucketBy(buckets, *S.UPSERT_KEY).sortBy(*S.UPSERT_KEY).option("path", path).saveAsTable(name, format="parquet")
    spark.sql(f"DROP TABLE {name}")
    write_marker(spark, f"{path}/{MARKER}{buckets}")


def _read_base(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """A base and the number of its buckets (0: plain files)."""
    buckets = max((int(n[len(MARKER) :]) for n in list_names(spark, path) if n.startswith(MARKER)), default=0)
    if not buckets:
        return spark.read.schema(LOG_SCHEMA).parquet(path), 0
    name, key = f"ledgerflow_base_{uuid.uuid4().hex}", ", ".join(S.UPSERT_KEY)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LOG_SCHEMA.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    base = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return base, buckets


def _merged(base: DataFrame, changes: DataFrame, buckets: int) -> DataFrame:
    """The base's rows with the changes, all of them later, put in. Equal keys meet in their bucket; a key with a null in it
    never equals another in a join, so the few such rows of both sides are grouped instead."""
    whole = reduce(and_, [F.col(k).isNotNull() for k in S.UPSERT_KEY])
    new = _latest(changes.where(whole).repartition(buckets, *S.UPSERT_KEY))
    changed, times = F.col("new.batch").isNotNull(), {"created_at": F.least, "updated_at": F.greatest}
    values = [c for c in LOG_SCHEMA.names if c not in S.UPSERT_KEY and c not in times]
    joined = base.where(whole).alias("old").join(new.alias("new"), S.UPSERT_KEY, "full_outer").select(
        *S.UPSERT_KEY,
        *[F.when(changed, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in values],
        *[pick(f"old.{c}", f"new.{c}").alias(c) for c, pick in times.items()],
    )
    return joined.unionByName(_latest(base.where(~whole).unionByName(changes.where(~whole))))


def _current(spark: SparkSession, root: str) -> tuple[DataFrame, int, int, list[str]]:
    """The stored rows with their log columns, the last batch among them (-1: none), the base's buckets, and the folders."""
    bases = _committed(spark, f"{root}/base", "upto")
    base = bases[-1] if bases else -1
    batches = [n for n in _committed(spark, f"{root}/changes", "batch") if n > base]
    folders = [f"{root}/base/upto={base}"] * bool(bases) + [f"{root}/changes/batch={n}" for n in batches]
    if not folders:
        return spark.createDataFrame([], LOG_SCHEMA), -1, 0, []
    stored, buckets = _read_base(spark, folders[0]) if bases else (None, 0)
    last = max([base, *batches])
    if bases and not batches:
        return stored, last, buckets, folders
    changes = spark.read.schema(LOG_SCHEMA).parquet(*folders[bool(bases) :])
    if buckets:
        return _merged(stored, changes, buckets), last, buckets, folders
    return _latest(changes if stored is None else stored.unionByName(changes)), last, 0, folders


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The current rows of the store."""
    return _current(spark, root)[0].select(*TABLE_COLUMNS)


def upsert_batch(successes: DataFrame, root: str, batch_id: int, *, now: Column | None = None) -> bool:
    """T5: add one micro-batch of successful messages; False if that batch is stored already."""
    spark = successes.sparkSession
    path = f"{root}/changes/batch={batch_id}"
    bases = _committed(spark, f"{root}/base", "upto")
    if (bases and bases[-1] >= batch_id) or path_exists(spark, f"{path}/_SUCCESS"):
        return False
    now = now if now is not None else F.current_timestamp()
    latest = latest_per_key(successes.select(*S.UPSERT_KEY, *S.UPSERT_FIELDS, "offset"), S.UPSERT_KEY)
    stamped = latest.withColumns({"created_at": now, "updated_at": now, "batch": F.lit(batch_id).cast("long")})
    stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields]).write.mode("overwrite").parquet(path)
    return True


def compact(spark: SparkSession, root: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Fold all changes into a new base and remove what it replaces; the last batch that it holds (-1: none)."""
    rows, last, buckets, folders = _current(spark, root)
    if last < 0:
        return last
    target = f"{root}/base/upto={last}"
    if not path_exists(spark, f"{target}/_SUCCESS"):
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        needed = min(most, 1 << max(0, -(-sum(stored_bytes(spark, f) for f in folders) // bucket_bytes) - 1).bit_length())
        if needed > buckets:
            rows, buckets = rows.repartition(needed, *S.UPSERT_KEY), needed
        _write_base(rows, target, buckets)
    for folder, name in ((f"{root}/base", "upto"), (f"{root}/changes", "batch")):
        for n in [int(x.split("=", 1)[1]) for x in list_names(spark, folder) if x.startswith(f"{name}=")]:
            if n < last or (n == last and name == "batch"):
                remove_path(spark, f"{folder}/{name}={n}")
    return last


def upsert_all(messages_final: DataFrame) -> DataFrame:
    """Batch twin of the stream's end state: the latest successful message per upsert key."""
    rows = messages_final.select(*S.UPSERT_KEY, *S.UPSERT_FIELDS, "offset", "status")
    latest = latest_per_key(rows, S.UPSERT_KEY, only_if=F.col("status") == "success")
    return latest.drop("offset", "status")
