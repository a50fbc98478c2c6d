"""Projections of the generated test tables onto the transaction layouts (see FIXTURES.md, part B).

* ``transactions``: lineitem ⨝ orders ⨝ customer ⨝ supplier as PaySim-style transfers (B1).
* ``topic_messages``: events as a keyed transaction topic (B2).
* ``payments`` / ``alerts``: events in the payment and fraud-alert test layouts (B3).

Join order for scale: orders ⨝ customer first (orders is a quarter of lineitem), then lineitem joins that
on the order key, then supplier. Joining lineitem to orders first would shuffle a lineitem-sized
intermediate a second time on the customer key. No side is forced to broadcast: supplier and customer
grow with the data, so Catalyst's size threshold and AQE's runtime statistics make that call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow import schemas as S

# Fixed mapping of order priority to transaction type (FIXTURES.md B1).
PRIORITY_TO_TYPE = {
    "1-URGENT": "TRANSFER",
    "2-HIGH": "CASH_OUT",
    "3-MEDIUM": "PAYMENT",
    "4-NOT SPECIFIED": "CASH_IN",
    "5-LOW": "DEBIT",
}
FIXTURE_EPOCH = "1995-01-01"
TOPIC_EPOCH = "2024-01-01"
TOPIC_PARTITIONS = 4
CURRENCY_CYCLE = ["USD", "EUR", "GBP"]
STATUS_CYCLE = ["completed", "pending", "failed", "fraudulent", "cancelled", "invalid_status"]
ORPHAN_OFFSET = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return m[key]


def _cycle(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one transfer per line item, money in DECIMAL(18,2) from the start."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")

    oc = orders.join(cust, orders.o_custkey == cust.c_custkey)
    j = li.join(oc, li.l_orderkey == oc.o_orderkey).join(supp, li.l_suppkey == supp.s_suppkey)

    amount = (
        F.col("l_extendedprice").cast(S.MONEY) * F.col("l_discount").cast("decimal(4,2)") * F.lit(2)
    ).cast(S.MONEY)
    days = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit(FIXTURE_EPOCH)))
    return j.select(
        (days * 24 + F.pmod(F.col("l_orderkey"), F.lit(24))).cast("int").alias("time_step"),
        _lookup(PRIORITY_TO_TYPE, F.col("o_orderpriority")).alias("transaction_type"),
        amount.alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sender_id"),
        F.col("c_acctbal").cast(S.MONEY).alias("sender_old_balance"),
        (F.col("c_acctbal").cast(S.MONEY) - amount).cast(S.MONEY).alias("sender_new_balance"),
        F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("receiver_id"),
        F.col("s_acctbal").cast(S.MONEY).alias("receiver_old_balance"),
        (F.col("s_acctbal").cast(S.MONEY) + amount).cast(S.MONEY).alias("receiver_new_balance"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 2)).alias("is_fraud"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 1)).alias("is_flagged_fraud"),
    )


def topic_messages(spark: SparkSession, sf_dir: str, envelope_every: int = 3) -> DataFrame:
    """B2: events as messages of a keyed topic (key, value, topic, partition, offset, timestamp).

    Every ``envelope_every``-th message (event_id mod n = n - 1) is wrapped as the producer sends it,
    ``{"event_type", "timestamp", "data": {...}}``; the rest are flat, as the consumer reads them.
    """
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    step = (F.datediff(F.to_date("ts"), F.to_date(F.lit(TOPIC_EPOCH))) * 24).cast("int")
    body = F.struct(
        step.alias("time_step"),
        F.col("event_type").alias("transaction_type"),
        F.when(F.pmod(eid, F.lit(50)) == 1, F.lit(None).cast("double")).otherwise(F.col("value")).alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("sender_id"),
        F.concat(F.lit("M"), F.col("event_type")).alias("receiver_id"),
    )
    # to_json drops null fields; the "error" messages must carry an explicit null, the "invalid" ones none
    flat = F.when(
        F.pmod(eid, F.lit(50)) == 0, F.to_json(body.dropFields("amount"))
    ).when(
        F.pmod(eid, F.lit(50)) == 1, F.regexp_replace(F.to_json(body), r"^\{", '{"amount":null,')
    ).otherwise(F.to_json(body))
    wrapped = F.concat(
        F.lit('{"event_type":"transaction_created","timestamp":"'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit('","data":'),
        flat,
        F.lit("}"),
    )
    if envelope_every:
        value = F.when(F.pmod(eid, F.lit(envelope_every)) == envelope_every - 1, wrapped).otherwise(flat)
    else:
        value = flat
    return ev.select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.get_json_object("props", "$.k")).alias("key"),
        value.alias("value"),
        F.lit("transactions").alias("topic"),
        F.pmod(F.col("user_id"), F.lit(TOPIC_PARTITIONS)).cast("int").alias("partition"),
        eid.alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the payment-transaction test layout."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("id"),
        (F.col("value").cast(S.MONEY) * F.lit(50)).cast("double").alias("amount"),
        _cycle(CURRENCY_CYCLE, F.pmod(eid, F.lit(3))).alias("currency"),
        _cycle(STATUS_CYCLE, F.pmod(eid, F.lit(6))).alias("status"),
        F.col("event_type").alias("payment_method"),
        F.col("ts").alias("created_at"),
        F.col("user_id"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a fraud alert; one in seventy of them points at no transaction."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("id"),
        (eid + F.when(F.pmod(eid, F.lit(70)) == 0, F.lit(ORPHAN_OFFSET)).otherwise(F.lit(0))).alias("transaction_id"),
        F.least(F.col("value") / F.lit(250.0), F.lit(1.0)).alias("risk_score"),
        _cycle(S.ALERT_TYPES, F.pmod(eid, F.lit(6))).alias("alert_type"),
        _cycle(S.ALERT_STATUSES, F.pmod(eid, F.lit(5))).alias("status"),
        F.col("ts").alias("created_at"),
        (F.col("value").cast(S.MONEY) * F.lit(50)).cast("double").alias("amount"),
        F.col("event_type").alias("payment_method"),
    )
