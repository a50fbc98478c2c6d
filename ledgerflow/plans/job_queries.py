"""Registered queries that run the jobs, the stream and the sinks over the fixtures and return what they stored.

Everything is written below the shared work folder, under a new name per run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import schemas as S
from ledgerflow.functions.features import col_or
from ledgerflow.functions.stats import exact_percentiles, with_global
from ledgerflow.operators import marts, metrics
from ledgerflow.operators.enrich import canonical_transactions, process_transactions
from ledgerflow.plans import jobs
from ledgerflow.plans.catalog import scored_transactions, stored_transactions
from ledgerflow.plans.oracle_sql import ORACLE as SQL
from ledgerflow.plans.oracle_sql import MESSAGES, with_ctes
from ledgerflow.session import work_path
from ledgerflow.sources import files, fixtures
from ledgerflow.sources.synthetic import first_available
from ledgerflow.sources.topics import read_topic_files
from ledgerflow.streaming import consumer, upsert

RUN_DAY, RANGE = "2019-03-01", ("2019-02-20", "2019-03-10")
ERRORS = 5  # failing rows of one check that a day may have in the backfill queries
STAMP = "2024-01-01 00:00:00"
KEPT_MS = 3650 * 24 * 3600 * 1000  # keys of the topic are remembered for ten years of event time: duplicates stand far apart
TOPIC_FILES, GROUP_BYTES = 20, 16 << 20
STATE_BYTES, LEAST_STATES = 32 << 20, 4  # stored bytes of the topic for each partition of the stream's state
MONEY = ["amount", "sender_old_balance", "sender_new_balance", "receiver_old_balance", "receiver_new_balance"]
RAW_ORDER = ["isFlaggedFraud", "nameDest", "newbalanceOrg", "oldbalanceOrg", "amount", "type", "step", "nameOrig", "newbalanceDest", "oldbalanceDest", "isFraud"]


def _double_money(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in MONEY if c in df.columns})


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_transactions(spark, sf_dir)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the work folder, for a query that passes over them several times."""
    spark, path = rows.sparkSession, work_path(rows.sparkSession, name, unique=True)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _topic_files(spark: SparkSession, messages: DataFrame, folder: str, n: int) -> list[str]:
    """Write the topic as ``n`` files in offset order, times of change included; their names in that order."""
    # row groups that a micro-batch of one large file can be read by in several tasks
    # bounds from the offsets alone: repartitionByRange would make all messages once more for its sample
    bounds = messages.approxQuantile("offset", [i / n for i in range(1, n)], 0.1 / n)
    place = F.coalesce(sum((F.col("offset") > F.lit(b)).cast("int") for b in sorted(set(bounds))), F.lit(0)) if bounds else F.lit(0)
    messages.repartitionById(n, place).sortWithinPartitions("offset").write.option("parquet.block.size", GROUP_BYTES).parquet(folder)
    fs, path_class = files._files(spark, folder)
    names = sorted(x for x in files.list_names(spark, folder) if x.startswith("part-"))
    for i, name in enumerate(names):
        fs.setTimes(path_class(f"{folder}/{name}"), 1_600_000_000_000 + 1000 * i, -1)
    return names


def _state_partitions(spark: SparkSession, folder: str) -> int:
    """State partitions for a topic, which grow with it up to the session's shuffle partitions."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(LEAST_STATES, -(-files.stored_bytes(spark, folder) // STATE_BYTES)))


_STREAMS: dict[tuple[str, str], str] = {}


def _stream(spark: SparkSession, sf_dir: str) -> str:
    """The store's folder of the stream job over the topic fixture: one run a session, which three queries read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STREAMS:
        _STREAMS[key] = _run_stream(spark, sf_dir)
    return _STREAMS[key]


def _run_stream(spark: SparkSession, sf_dir: str) -> str:
    """Run it one file a micro-batch, with a stop after half of the files, a compaction of the store, and a restart from the
    checkpoint."""
    root = work_path(spark, "stream", unique=True)
    names = _topic_files(spark, fixtures.topic_messages(spark, sf_dir), f"{root}/all", TOPIC_FILES)
    states = _state_partitions(spark, f"{root}/all")
    fs, path_class = files._files(spark, root)
    fs.mkdirs(path_class(f"{root}/topic"))
    for arrived in (names[: TOPIC_FILES // 2], names[TOPIC_FILES // 2 :]):
        for name in arrived:
            if not fs.rename(path_class(f"{root}/all/{name}"), path_class(f"{root}/topic/{name}")):
                raise OSError(f"can't move {name}")
        source = read_topic_files(spark, f"{root}/topic", max_files_per_trigger=1)
        query = consumer.start_transaction_stream(source, f"{root}/store", f"{root}/progress", state_ttl_ms=KEPT_MS, statuses=True, event_time=True, state_partitions=states)
        query.awaitTermination()
        upsert.compact(spark, f"{root}/store")
    files.remove_path(spark, f"{root}/topic")
    return f"{root}/store"


def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that the stream stored, after compactions and a restart."""
    return _double_money(upsert.read_table(spark, _stream(spark, sf_dir)).select(*S.UPSERT_KEY, *S.UPSERT_FIELDS))


def stream_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: every message's final status, as the stream found it."""
    return spark.read.parquet(f"{_stream(spark, sf_dir)}/statuses").select("message_key", "offset", "status")


def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per status over all micro-batches of both runs, and the number of batches."""
    counts = spark.read.parquet(f"{_stream(spark, sf_dir)}/status_counts")
    return counts.groupBy("status").agg(F.sum("messages").alias("messages"), F.count_distinct("batch").alias("batches"))


def lake_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.lake_round_trip(_double_money(_scored(spark, sf_dir)), work_path(spark, "lake", unique=True), RUN_DAY)


def warehouse_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart rows that the daily job stored for its day."""
    root = work_path(spark, "warehouse", unique=True)
    jobs.daily_warehouse_job(spark, _scored(spark, sf_dir), root, RUN_DAY, now=F.lit(STAMP).cast("timestamp"))
    return files.read_lake(spark, f"{root}/daily_transaction_summary").select(*marts.MART_COLUMNS)


def backfill_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: the status row of every day of the range."""
    root = work_path(spark, "backfill", unique=True)
    return jobs.backfill(spark, _scored(spark, sf_dir), root, *RANGE, now=F.lit(STAMP).cast("timestamp"), error_above=ERRORS)


def backfill_with_a_bad_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: a range is loaded, then loaded again with amounts one higher and no sender on one day: per day what is stored and
    the second run's status. The bad day keeps the first load's rows."""
    root, stamp = work_path(spark, "poisoned", unique=True), F.lit(STAMP).cast("timestamp")
    scored = _scored(spark, sf_dir)
    jobs.backfill(spark, scored, root, *RANGE, now=stamp)
    bad = F.to_date("transaction_date") == F.lit(RUN_DAY).cast("date")
    changed = scored.withColumns({"amount": (F.col("amount") + 1).cast(scored.schema["amount"].dataType), "sender_id": F.when(~bad, F.col("sender_id"))})
    # the bad day has every row several times as well: more failing rows than are let through, however few the day has
    copies = F.when(bad, F.sequence(F.lit(0), F.lit(ERRORS))).otherwise(F.array(F.lit(0)))
    changed = changed.withColumn("_copy", F.explode(copies)).drop("_copy")
    status = jobs.backfill(spark, changed, root, *RANGE, now=stamp, error_above=ERRORS)
    stored = files.read_lake(spark, f"{root}/transactions_processed").groupBy("date").agg(F.count(F.lit(1)).alias("stored_rows"), F.sum("amount").cast("double").alias("stored_amount"))
    return status.select("date", "status").join(stored, "date", "left").select("date", "status", F.coalesce("stored_rows", F.lit(0)).cast("long").alias("stored_rows"), F.coalesce("stored_amount", F.lit(0.0)).alias("stored_amount"))


def lake_etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's result row, its metrics as columns."""
    raw = {v: k for k, v in S.RAW_TO_CANONICAL.items() if k in RAW_ORDER}
    source = fixtures.transactions(spark, sf_dir).withColumnsRenamed(raw)
    row = jobs.daily_lake_etl(spark, source, work_path(spark, "etl", unique=True), RUN_DAY)
    m = F.from_json("metrics", "fraud_rate double, avg_amount double, fraud_amount double, avg_risk_score double, high_risk_transactions long")
    return row.select("status", "date", "transactions_processed", "fraud_alerts_processed", m.alias("m")).select("status", "date", "transactions_processed", "fraud_alerts_processed", "m.*")


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the bundle in long form."""
    return metrics.bundle_rows(metrics.analytics_bundle(_scored(spark, sf_dir)))


def loaded_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of processed rows, the first of them repeated: per type the rows of the table and of the rejected ones,
    in which every row stands once."""
    path = work_path(spark, "loads", unique=True)
    # a load reads its rows twice, for those that fit and those that don't: scored once and stored
    rows = _stored(process_transactions(_scored(spark, sf_dir), processed_at=F.lit(STAMP).cast("timestamp")), "processed")
    first = F.pmod("time_step", F.lit(2)) == 0
    for load, part in (("a", first), ("b", ~first), ("a", first)):
        files.append_processed(rows.where(part), path, load_id=load)
    stored = files.read_loads(spark, path, S.PROCESSED_TRANSACTION).select("transaction_type", F.col("amount").cast("decimal(18,2)").alias("amount"))
    rejected = T.StructType([f for f in rows.schema.fields if f.name in ("transaction_type", "amount")])
    stored = stored.unionByName(files.read_loads(spark, f"{path}_rejected", rejected))
    return stored.groupBy("transaction_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("double").alias("amount"))


def inserted_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions inserted under one load id, twice; the table's rows."""
    path = work_path(spark, "inserts", unique=True)
    rows = stored_transactions(spark, sf_dir)  # each insert reads its rows twice
    for _ in range(2):
        files.append_transactions(rows, path, load_id="only")
    stored = files.read_loads(spark, path, S.TRANSACTION)
    return stored.groupBy("transaction_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("double").alias("amount"))


SEED_TYPES = {"c_custkey": "bigint", "c_mktsegment": "varchar(9)", "c_acctbal": "decimal(10,2)"}  # AUTOMOBILE is one too long


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a seed CSV, loaded into a table with declared lengths: rows and sums per segment, stored and rejected."""
    path = work_path(spark, "seed", unique=True)
    spark.read.parquet(f"{sf_dir}/customer.parquet").select(*SEED_TYPES).write.option("header", True).csv(f"{path}/csv")
    stored, rejected = files.store_seed(spark, f"{path}/csv", SEED_TYPES, f"{path}/table")
    both = stored.select(F.lit("stored").alias("place"), "*").unionByName(rejected.select(F.lit("rejected").alias("place"), *SEED_TYPES))
    return both.groupBy("place", "c_mktsegment").agg(F.count(F.lit(1)).alias("rows"), F.sum("c_acctbal").cast("double").alias("balance"))


def from_first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an absent lake, an empty one and the transactions, the first that has rows, with its name; counts per type."""
    path = work_path(spark, "sources", unique=True)
    rows = fixtures.transactions(spark, sf_dir)
    rows.where("false").write.parquet(f"{path}/empty")
    sources = [("absent", lambda: spark.read.parquet(f"{path}/absent")), ("empty", lambda: files.read_lake(spark, f"{path}/empty", rows.schema)), ("tables", lambda: rows)]
    found, label = first_available(sources)
    return found.groupBy(F.lit(label).alias("source"), "transaction_type").agg(F.count(F.lit(1)).alias("rows"))


def either_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: the same totals from tables with raw and with canonical names."""
    canonical = fixtures.transactions(spark, sf_dir)
    raw = canonical.withColumnsRenamed({v: k for k, v in S.RAW_TO_CANONICAL.items() if k in RAW_ORDER})
    parts = [
        df.select(F.lit(label).alias("spelling"), col_or(df, "type", "transaction_type").alias("transaction_type"), col_or(df, "oldbalanceOrg", "sender_old_balance").alias("balance"))
        for label, df in (("raw", raw), ("canonical", canonical))
    ]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("spelling", "transaction_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("balance").cast("double").alias("balance"))


def csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions written as CSV with raw names in another order, read back by name."""
    raw = {v: k for k, v in S.RAW_TO_CANONICAL.items() if k in RAW_ORDER}
    t = fixtures.transactions(spark, sf_dir)
    cols = {raw.get(c, c): F.col(c).cast("int") if c.startswith("is_") else F.col(c) for c in t.columns}
    path = work_path(spark, "csv", unique=True)
    t.select(*[cols[c].alias(c) for c in RAW_ORDER]).write.option("header", True).csv(path)
    return _double_money(canonical_transactions(files.read_transactions_csv(spark, path)).select(*t.columns))


def stored_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart as a named table."""
    mart = marts.daily_transaction_summary(_scored(spark, sf_dir))
    return files.materialize(mart, "daily_transaction_summary", "table", work_path(spark, "mart", unique=True))


def load_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed rows with the load's time."""
    return _double_money(process_transactions(_scored(spark, sf_dir), processed_at=F.to_timestamp_ntz(F.lit(STAMP))))


def against_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows above the 95th percentile of the amount, the percentile attached to every row."""
    t = stored_transactions(spark, sf_dir)
    p95 = exact_percentiles(t, "amount", [0.95])[0.95]
    row = spark.range(1).select(F.lit(p95).cast("double").alias("p95"))
    return with_global(t, row).where(F.col("amount").cast("double") > F.col("p95")).select("time_step", "sender_id", "receiver_id", F.col("amount").cast("double").alias("amount"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "t1_stream_store": stream_store,
    "t4_stream_status": stream_statuses,
    "t1_stream_restart": stream_restart,
    "d4_round_trip": lake_round_trip,
    "d2_mart": warehouse_mart,
    "d3_backfill_status": backfill_status,
    "d3_bad_day": backfill_with_a_bad_day,
    "d1_lake_etl": lake_etl,
    "a10_bundle": bundle,
    "s7_loaded_twice": loaded_twice,
    "s14_inserted_twice": inserted_twice,
    "s13_seed": seeded,
    "s11_first_available": from_first_available,
    "p20_either_spelling": either_spelling,
    "s1_p1_csv": csv_by_name,
    "s12_mart": stored_mart,
    "p15_load_stamps": load_stamps,
    "j3_above_p95": against_global,
}

_P9 = SQL["p9_scored_transactions"]
_CHECKS = ["amount IS NULL", "risk_score < 0 OR risk_score > 1", "transaction_date IS NULL", "receiver_id IS NULL OR trim(receiver_id) = ''",
           "amount < 0.01 OR amount > 1000000", "amount <= 0", "amount > 100000", "sender_id IS NULL"]
_P9_PLUS_ONE = f"SELECT * REPLACE (amount + 1 AS amount) FROM ({_P9})"
_DAYS = f"""WITH t AS ({_P9}),
    per_day AS (SELECT CAST(d.day AS DATE) AS date, COUNT(t.time_step) AS rows, COUNT(*) FILTER (WHERE t.is_fraud) AS fraud_rows,
        greatest({', '.join(f"COUNT(t.time_step) FILTER (WHERE {c})" for c in _CHECKS)}) AS worst_check_failures
        FROM generate_series(DATE '{RANGE[0]}', DATE '{RANGE[1]}', INTERVAL 1 DAY) d(day)
        LEFT JOIN t ON CAST(t.transaction_date AS DATE) = CAST(d.day AS DATE) GROUP BY 1),
    days AS (SELECT *, CASE WHEN rows = 0 THEN 'empty' WHEN worst_check_failures > {ERRORS} THEN 'failed' ELSE 'success' END AS status FROM per_day),
    sums AS (SELECT CAST(d.day AS DATE) AS date, coalesce(SUM(CAST(amount AS DECIMAL(18,2))), 0) AS amount, COUNT(amount) AS amount_n
        FROM generate_series(DATE '{RANGE[0]}', DATE '{RANGE[1]}', INTERVAL 1 DAY) d(day)
        LEFT JOIN t ON CAST(t.transaction_date AS DATE) = CAST(d.day AS DATE) GROUP BY 1)
"""
ORACLE: dict[str, str] = {
    "t1_stream_store": SQL["j4_upserted_transactions"],
    "t4_stream_status": with_ctes(MESSAGES, body='SELECT message_key, "offset", status FROM final'),
    "t1_stream_restart": with_ctes(MESSAGES, body=f"SELECT status, COUNT(*) AS messages, CAST({TOPIC_FILES} AS BIGINT) AS batches FROM final GROUP BY status"),
    "d4_round_trip": f"SELECT *, DATE '{RUN_DAY}' AS date FROM ({_P9})",
    "d2_mart": f"SELECT * FROM ({SQL['a20_daily_transaction_summary']}) WHERE date = DATE '{RUN_DAY}'",
    "d3_backfill_status": _DAYS + "SELECT * FROM days",
    "d3_bad_day": _DAYS.replace(f"WITH t AS ({_P9})", f"WITH t AS ({_P9_PLUS_ONE})") + f"""SELECT date, CASE WHEN date = DATE '{RUN_DAY}' THEN 'failed' ELSE status END AS status, rows AS stored_rows,
        CAST(amount - CASE WHEN date = DATE '{RUN_DAY}' OR status = 'failed' THEN amount_n ELSE 0 END AS DOUBLE) AS stored_amount
        FROM days JOIN sums USING (date)""",
    "d1_lake_etl": f"""SELECT 'success' AS status, DATE '{RUN_DAY}' AS date, total_transactions AS transactions_processed, total_fraud AS fraud_alerts_processed,
        fraud_rate, avg_amount, fraud_amount, avg_risk_score, high_risk_transactions FROM ({SQL['a1_fraud_metrics']})""",
    "a10_bundle": " UNION ALL ".join([
        *[f"SELECT '{m}' AS metric, CAST({k} AS VARCHAR) AS item, CAST({v} AS DOUBLE) AS value FROM ({SQL[q]})" for m, q, k, v in [
            ("transaction_types", "a4_type_distribution", "transaction_type", "transaction_count"), ("transactions_by_step", "a3_transactions_by_step", "time_step", "transaction_count"),
            ("amount_distribution", "a5_amount_distribution", "amount_category", "transaction_count"), ("fraud_by_type", "a6_fraud_by_type", "transaction_type", "fraud_count"),
            ("fraud_by_step", "a8_fraud_by_step", "time_step", "fraud_count")]],
        *[f"SELECT '{m}', '{c}', CAST({c} AS DOUBLE) FROM ({SQL[q]})" for m, q, cs in [
            ("summary", "a2_summary", "total_transactions total_fraud fraud_rate total_volume avg_amount fraud_amount avg_fraud_amount"),
            ("fraud_amount_stats", "a7_fraud_amount_stats", "total_fraud_amount avg_fraud_amount max_fraud_amount min_fraud_amount"),
            ("fraud_statistics", "a9_detection_stats", "total_fraud flagged_fraud detection_rate")] for c in cs.split()]]),
    "s7_loaded_twice": f"SELECT transaction_type, COUNT(*) AS rows, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM ({_P9}) GROUP BY 1",
    "s14_inserted_twice": f"SELECT transaction_type, COUNT(*) AS rows, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM ({_P9}) WHERE amount > 0 GROUP BY 1",
    "s13_seed": """SELECT CASE WHEN length(c_mktsegment) > 9 THEN 'rejected' ELSE 'stored' END AS place, c_mktsegment, COUNT(*) AS rows,
        CAST(SUM(CAST(c_acctbal AS DECIMAL(10,2))) AS DOUBLE) AS balance FROM customer GROUP BY 1, 2""",
    "s11_first_available": f"SELECT 'tables' AS source, transaction_type, COUNT(*) AS rows FROM ({_P9}) GROUP BY 2",
    "p20_either_spelling": f"""SELECT spelling, transaction_type, COUNT(*) AS rows, CAST(SUM(CAST(sender_old_balance AS DECIMAL(18,2))) AS DOUBLE) AS balance
        FROM ({_P9}) CROSS JOIN (VALUES ('raw'), ('canonical')) v(spelling) GROUP BY 1, 2""",
    "s1_p1_csv": f"""SELECT time_step, transaction_type, amount, sender_id, sender_old_balance, sender_new_balance, receiver_id,
        receiver_old_balance, receiver_new_balance, is_fraud, is_flagged_fraud FROM ({_P9})""",
    "s12_mart": SQL["a20_daily_transaction_summary"],
    "p15_load_stamps": f"SELECT *, TIMESTAMP '{STAMP}' AS processed_at FROM ({SQL['p15_processed_transactions']})",
    "j3_above_p95": f"SELECT time_step, sender_id, receiver_id, amount FROM ({_P9}) WHERE unusual_amount",
}
