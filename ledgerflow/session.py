"""Session construction and the shared work folder.

On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/ABFS); every lineage cut and every
table the library writes for itself goes below it. A machine-local temporary folder is only used when the
setting is absent and the master is local, as in unit tests; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# The library's session defaults; keyword arguments of ``get_session`` override them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    # joins are never broadcast on a size *estimate* (a fact table can look small before its filters run
    # and a dimension grows with the data); AQE broadcasts a side only when its measured shuffle output
    # is under the threshold, and sort-merges otherwise
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # re-running a daily job replaces only the partitions it writes
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    # keyed stream state (message keys, unbounded in number) lives in RocksDB on local disk with changelog
    # checkpoints to the checkpoint folder, not in executor heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "ledgerflow", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring one only when the session has none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared checkpoint folder for tables written by the library itself."""
    base = checkpoint_dir(spark).rstrip("/")
    tail = "/".join(p.strip("/") for p in parts)
    if unique:
        tail = f"{tail}-{uuid.uuid4().hex[:12]}" if tail else uuid.uuid4().hex[:12]
    return f"{base}/ledgerflow/{tail}" if tail else f"{base}/ledgerflow"
