"""Message de-duplication (W1, T4) and latest row per upsert key.

Rule (per message key, in offset order): a key counts as seen only after a successful message. So the
first ``ok`` message is ``success``; every later message with that key is ``duplicate`` (even a malformed
one); ``invalid``/``error`` messages before it keep their status. A key lives in one topic partition, so
offsets order its messages.

Batch form: the first good offset per key is an aggregate (map-side combined, so a key with a third of
all messages is one partial row per task), joined back on the key. Stream form: the state store holds the keys that have had a good message
(``dropDuplicatesWithinWatermark``, no Python), and each micro-batch applies the rule to its own messages. A required time
bounds the state (the reference keeps an unbounded in-memory set that a restart loses); a duplicate arriving
after its key expired is admitted and then absorbed by the idempotent upsert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_batch(classified: DataFrame) -> DataFrame:
    """Final status per message over a whole batch of classified messages."""
    # a conditional aggregate, not a filter: a filter on the derived status would be pushed below the
    # decode projection and repeat the JSON parse inside the predicate
    firsts = classified.groupBy("message_key").agg(
        F.min(F.when(F.col("status") == "ok", F.col("offset"))).alias("_first_ok")
    )
    j = classified.join(firsts, "message_key", "left")
    first = F.col("_first_ok")
    status = (
        F.when(first.isNull(), F.col("status"))
        .when(F.col("offset") == first, F.lit("success"))
        .when(F.col("offset") > first, F.lit("duplicate"))
        .otherwise(F.col("status"))
    )
    return j.withColumn("status", status).drop("_first_ok")


def latest_per_key(df: DataFrame, keys: list[str], order_col: str = "offset", *, only_if=None) -> DataFrame:
    """The last-arriving row per key (``max_by`` aggregates partially, so hot keys do not pile up).

    ``only_if`` restricts the candidates inside the aggregate (rows where it is false have a null ordering,
    which ``max_by`` skips); keys with no candidate are dropped.
    """
    cols = [c for c in df.columns if c not in keys]
    order = F.col(order_col) if only_if is None else F.when(only_if, F.col(order_col))
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*cols), order).alias("_row"), F.max(order).alias("_last"))
        .where(F.col("_last").isNotNull())
        .select(*keys, "_row.*")
    )


# --- stream form --------------------------------------------------------------------------------


def with_new_keys(classified: DataFrame, event_time: str, remember_ms: int) -> DataFrame:
    """T4, the keyed state: every message (``kind`` = row) and, once per key that isn't remembered, the key and time of one of its
    good messages (``kind`` = new, other columns null). The state is Spark's own for ``dropDuplicatesWithinWatermark``: a key is remembered until the watermark,
    ``remember_ms`` behind the latest good message, has passed its time."""
    good = classified.where(F.col("status") == "ok").select("message_key", event_time).withWatermark(event_time, f"{int(remember_ms)} milliseconds")
    new = good.dropDuplicatesWithinWatermark(["message_key"])
    return classified.withColumn("kind", F.lit("row")).unionByName(new.withColumn("kind", F.lit("new")), allowMissingColumns=True)


def batch_keys(batch: DataFrame, event_time: str) -> DataFrame:
    """Per key of a micro-batch of ``with_new_keys``: its first good offset, the times of its good messages, how many have none,
    and whether the state didn't have the key."""
    time, ok = F.col(event_time), (F.col("kind") == "row") & (F.col("status") == "ok")
    return batch.groupBy("message_key").agg(
        F.min(F.when(ok, F.col("offset"))).alias("_first_ok"), F.min(F.when(ok, time)).alias("_time"), F.max(F.when(ok, time)).alias("_latest"),
        F.count_if(ok & time.isNull()).alias("_untimed"), F.bool_or(F.col("kind") == "new").alias("_new"))


def unsure_keys(keys: DataFrame, horizon: Column) -> DataFrame:
    """The keys of ``batch_keys`` that the state says nothing about: without a good message or with a late one."""
    return keys.where(~F.col("_new") & (F.col("_first_ok").isNull() | (F.col("_untimed") > 0) | F.coalesce(F.col("_time") < horizon, F.lit(True))))


def batch_statuses(batch: DataFrame, event_time: str, horizon: Column, remembered: DataFrame, *, keys: DataFrame | None = None, few: bool = False) -> DataFrame:
    """T4: the W1 rule for one micro-batch of ``with_new_keys``.

    A key of the batch is known to be new, or, if it has a good message that isn't late, known to be remembered. Only the
    others, keys without a good message and late ones (before ``horizon``), are looked up in ``remembered`` (message_key and
    its first good message's time), of which times before the horizon are forgotten. Per-key results are aggregates joined
    back, so a hot key is one row per task. ``keys`` is the batch's ``batch_keys`` where it is kept already. ``few`` says that the
    keys to look up can be sent to every executor: what is remembered, all earlier batches, is then read without a shuffle."""
    rows = batch.where(F.col("kind") == "row").drop("kind")
    keys = batch_keys(batch, event_time) if keys is None else keys
    unsure = unsure_keys(keys, horizon).select("message_key")
    old = remembered.where(F.col(event_time) >= horizon).join(F.broadcast(unsure) if few else unsure, "message_key", "left_semi").select("message_key").distinct()
    # a key is seen unless it is new or, looked up, not found
    asked = unsure.join(old, "message_key", "left_anti").select("message_key", F.lit(True).alias("_unseen"))
    known = keys.join(asked, "message_key", "left").select("message_key", "_first_ok", (~F.col("_new") & F.col("_unseen").isNull()).alias("_seen"))
    first = F.col("_first_ok")
    status = (
        F.when(F.col("_seen"), F.lit("duplicate"))
        .when(first.isNull(), F.col("status"))
        .when(F.col("offset") == first, F.lit("success"))
        .when(F.col("offset") > first, F.lit("duplicate"))
        .otherwise(F.col("status"))
    )
    return rows.join(known, "message_key", "left").withColumn("status", status).drop("_first_ok", "_seen")
