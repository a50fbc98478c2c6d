"""File and table sources and sinks.

* Every read has an explicit schema (no inference).
* The lake is Parquet partitioned by ``date``. A job declares the dates it replaces: its rows are written to a
  hidden folder beside the partitions and published together by one renamed manifest, then moved in, and a declared date
  without rows loses its old partition (``replace_partitions``).
* Date filters are half-open ranges on the raw timestamp column, so they reach the Parquet scan as
  pushed filters; on a date-partitioned lake they prune partitions.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from datetime import date as Date
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import schemas as S
from ledgerflow.operators.enrich import rows_of_day

MANIFESTS = ".manifests"
READ_ATTEMPTS = 5

# --- reads ---------------------------------------------------------------------------------------


def read_transactions_csv(spark: SparkSession, path: str, schema: T.StructType = S.RAW_TRANSACTION) -> DataFrame:
    """CSV files with a header, read by the header's names in whatever order they stand. Known columns
    (in either spelling) get their types, others pass through as text; a missing path fails at once. All
    files must have the same header, which Spark checks."""
    header = spark.read.text(path).first()
    if header is None:
        return spark.createDataFrame([], schema)
    names = spark.read.option("header", False).csv(spark.sparkContext.parallelize([header[0]])).first()
    types = {f.name: f.dataType for f in schema.fields}
    either = {"newbalanceOrig": "newbalanceOrg", "newbalanceOrg": "newbalanceOrig"}
    in_file = T.StructType([T.StructField(n, types.get(n, types.get(either.get(n), T.StringType()))) for n in names])
    return spark.read.schema(in_file).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_transactions_for_date(df: DataFrame, day: str | Date, ts_col: str = "transaction_date") -> DataFrame:
    """S3: the rows of one date from a table (range predicate, pushes down)."""
    return rows_of_day(df, str(day), ts_col)


def read_transactions_table(spark: SparkSession, url: str, table: str, properties: dict | None = None,
                            *, partition_column: str | None = None, lower: int | None = None,
                            upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """A whole database table into the canonical columns (JDBC; parallel when a numeric partition
    column and its bounds are given)."""
    props = dict(properties or {})
    if partition_column:
        df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                             numPartitions=num_partitions, properties=props)
    else:
        df = spark.read.jdbc(url, table, properties=props)
    from ledgerflow.operators.enrich import canonical_transactions

    return canonical_transactions(df)


def read_lake(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet with partition discovery (``date=YYYY-MM-DD`` becomes a column), as of the last publish: partitions that
    ``replace_partitions`` has published but not yet moved are read where they lie."""
    root = path.rstrip("/")
    for _ in range(READ_ATTEMPTS):
        before = _manifest(spark, root)
        df = _read_published(spark, root, schema, *before[1:])
        if _manifest(spark, root)[:2] == before[:2]:  # else folders were moved while they were listed
            return df
    raise OSError(f"{root} was published anew at each of {READ_ATTEMPTS} attempts to read it")


def _read_published(spark: SparkSession, root: str, schema: T.StructType | None, settled: bool, content: dict) -> DataFrame:
    def read(base: str, names: list[str] | None) -> DataFrame:
        reader = spark.read.option("basePath", base)
        reader = reader if schema is None else reader.schema(schema)
        return reader.parquet(*([base] if names is None else [f"{base}/{n}" for n in names]))

    if settled:
        return read(root, None)
    replaced, staging = content["folders"], f"{root}/{content['staging']}"
    there, waiting = set(list_names(spark, root)), [n for n in list_names(spark, staging) if n in replaced]
    placed = [n for n in there if "=" in n and (n not in replaced or (replaced[n] and n not in waiting))]
    parts = [read(base, sorted(names)) for base, names in ((root, placed), (staging, waiting)) if names]
    if not parts:
        return read(root, None)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_seed(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A seed CSV with declared column types (e.g. ``{"amount": "decimal(10,2)"}``). ``varchar(n)`` /
    ``char(n)`` are read as strings; ``store_seed`` makes a table in which their lengths hold."""
    ddl = ", ".join(f"`{k}` {re.sub(r'^(var)?char\(\d+\)$', 'string', v.strip(), flags=re.I)}" for k, v in types.items())
    return spark.read.schema(ddl).option("header", True).option("mode", "FAILFAST").csv(path)


def store_seed(spark: SparkSession, path: str, types: dict[str, str], table: str) -> tuple[DataFrame, DataFrame]:
    """Load a seed CSV into a Parquet table at ``table`` (replaced) with the declared types; the table's rows and the rejected
    ones. The table is declared with its ``varchar(n)`` and ``char(n)`` columns, so Spark itself checks lengths at the
    write (spaces at the end beyond a length are cut, as in SQL). Rows that it would refuse go to ``<table>_rejected`` as
    they stand in the file, with the names of the columns that are too long."""
    rows = read_seed(spark, path, types)
    lengths = {c: int(m[1]) for c, t in types.items() if (m := re.fullmatch(r"(?:var)?char\((\d+)\)", t.strip(), flags=re.I))}
    too_long = F.array_compact(F.array(*[F.when(F.char_length(F.rtrim(c)) > n, F.lit(c)) for c, n in lengths.items()]).cast("array<string>"))
    tagged = rows.withColumn("rejected", too_long)
    name, rejected = f"ledgerflow_seed_{uuid.uuid4().hex}", f"{table.rstrip('/')}_rejected"
    tagged.where(F.size("rejected") > 0).write.mode("overwrite").parquet(rejected)
    remove_path(spark, table)
    spark.sql(f"CREATE TABLE {name} ({', '.join(f'`{c}` {t}' for c, t in types.items())}) USING parquet LOCATION '{table}'")
    try:
        tagged.where(F.size("rejected") == 0).drop("rejected").write.insertInto(name)
        stored = spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # the entry of the session's catalog; the files stay
    return stored, spark.read.schema(tagged.schema).parquet(rejected)


# --- writes --------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """(Hadoop file system, its path class) for a path; errors of the store are raised, never taken for absence."""
    path_class = spark._jvm.org.apache.hadoop.fs.Path
    return path_class(path).getFileSystem(spark._jsc.hadoopConfiguration()), path_class


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, path_class = _files(spark, path)
    return fs.exists(path_class(path))


def remove_path(spark: SparkSession, path: str) -> None:
    fs, path_class = _files(spark, path)
    fs.delete(path_class(path), True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; an absent folder is empty."""
    fs, path_class = _files(spark, path)
    if not fs.exists(path_class(path)):
        return []
    return [x.getPath().getName() for x in fs.listStatus(path_class(path))]


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    fs, path_class = _files(spark, path)
    return fs.getContentSummary(path_class(path)).getLength()


def write_marker(spark: SparkSession, path: str) -> None:
    """An empty file whose name says something."""
    fs, path_class = _files(spark, path)
    fs.create(path_class(path), True).close()


def _renamed(fs, path_class, source: str, target: str) -> None:
    if not fs.rename(path_class(source), path_class(target)):
        raise OSError(f"can't move {source} to {target}")


def _write_text(fs, path_class, path: str, text: str) -> None:
    out = fs.create(path_class(path), False)  # fails if it is there
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _manifest(spark: SparkSession, root: str) -> tuple[int, bool, dict]:
    """The table's last publish: its number (0: none), whether all its folders are in place, and its content."""
    names = list_names(spark, f"{root}/{MANIFESTS}")
    last = max((int(n[: -len(".json")]) for n in names if n.endswith(".json")), default=0)
    if not last:
        return 0, True, {}
    text = "\n".join(r.value for r in spark.read.text(f"{root}/{MANIFESTS}/{last}.json").collect())
    return last, f"{last}.settled" in names, json.loads(text)


def settle(spark: SparkSession, path: str) -> None:
    """Bring the folders of the last publish into place, wherever an earlier attempt stopped; safe to repeat."""
    root = path.rstrip("/")
    number, settled, content = _manifest(spark, root)
    if settled:
        return
    fs, path_class = _files(spark, root)
    staging, old = f"{root}/{content['staging']}", f"{root}/.old-{number}"
    for name, has_rows in content["folders"].items():
        source, target, aside = f"{staging}/{name}", f"{root}/{name}", f"{old}/{name}"
        waiting = has_rows and fs.exists(path_class(source))
        if (waiting or not has_rows) and fs.exists(path_class(target)):
            fs.mkdirs(path_class(old))
            _renamed(fs, path_class, target, aside)
        if waiting:
            _renamed(fs, path_class, source, target)
    _write_text(fs, path_class, f"{root}/{MANIFESTS}/{number}.settled", "")
    for leftover in (staging, old, f"{root}/{MANIFESTS}/{number - 1}.json", f"{root}/{MANIFESTS}/{number - 1}.settled"):
        fs.delete(path_class(leftover), True)


def replace_partitions(df: DataFrame, path: str, column: str, values: Sequence[str]) -> None:
    """Make the partitions ``column=value`` of the declared values hold exactly ``df``'s rows; other partitions stay.

    All rows are written to a staging folder first. Then a manifest, a numbered file that names the staging folder and the
    partitions it replaces, is renamed into ``.manifests``: that one call publishes all partitions together. Until then
    every reader sees the old rows; from then on ``read_lake`` gives the new ones, from the staging folder as long as they
    aren't in place. Old folders are moved aside, new ones moved in, and the old ones deleted only when all are
    in place. A call that fails in between loses nothing: the next write or ``settle`` goes on from there.
    One writer a table: of two, the second can't rename its manifest and fails. Rows of values that weren't declared are an
    error."""
    spark = df.sparkSession
    root = path.rstrip("/")
    settle(spark, root)
    number = _manifest(spark, root)[0] + 1
    fs, path_class = _files(spark, root)
    staging, manifest = f".staging-{uuid.uuid4().hex[:12]}", f"{root}/{MANIFESTS}/{number}.json"
    try:
        df.write.partitionBy(column).parquet(f"{root}/{staging}")
        written = {n for n in list_names(spark, f"{root}/{staging}") if n.startswith(f"{column}=")}
        declared = [f"{column}={v}" for v in values]
        if not written <= set(declared):
            raise ValueError(f"rows of partitions that weren't declared: {sorted(written - set(declared))}")
        fs.mkdirs(path_class(f"{root}/{MANIFESTS}"))
        own = f"{root}/{MANIFESTS}/{staging}.tmp"
        _write_text(fs, path_class, own, json.dumps({"staging": staging, "folders": {n: n in written for n in declared}}))
        if fs.exists(path_class(manifest)):
            raise OSError(f"another writer has published {manifest}")
        _renamed(fs, path_class, own, manifest)
    except BaseException:
        # only where it is certain that nothing was published; otherwise the folder may be the table's
        if not path_exists(spark, manifest):
            remove_path(spark, f"{root}/{staging}")
        raise
    settle(spark, root)


def days_between(start: str | Date, end: str | Date) -> list[str]:
    first, last = Date.fromisoformat(str(start)), Date.fromisoformat(str(end))
    return [(first + timedelta(days=i)).isoformat() for i in range((last - first).days + 1)]


def write_lake(df: DataFrame, path: str, run_date: str | Date) -> str:
    """Write ``df`` under ``path/date=YYYY-MM-DD/``; re-running the same date replaces it, also by nothing;
    other dates stay. Returns the partition path."""
    day = str(run_date)
    replace_partitions(df.withColumn("date", F.lit(day)), path, "date", [day])
    return f"{path.rstrip('/')}/date={day}"


def _fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The DDL's columns (what doesn't fit is null), the row's own columns as ``own``, and ``rejected``."""
    there = [f for f in schema.fields if f.name in df.columns]
    # a column of the DDL's own type fits: a check of each such column would only make the generated code too long to compile
    cast = [f for f in there if df.schema[f.name].dataType != f.dataType]
    unfit = F.array_compact(F.array(*[
        F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("value")))
        for f in cast
    ]).cast("array<struct<column: string, value: string>>"))
    cols = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f in cast else F.col(f.name) if f in there else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*cols, F.struct(*df.columns).alias("own"), unfit.alias("rejected"))


def conform(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Split rows by whether they fit a fixed DDL: (rows cast to it, rejected rows). A rejected row keeps all its
    own columns and lists in ``rejected`` each column that doesn't fit (e.g. a ratio over DECIMAL(5,4)) with its
    value as text. Columns that the input lacks are null."""
    fitted = _fitted(df, schema)
    return fitted.where(F.size("rejected") == 0).select(*schema.names), fitted.where(F.size("rejected") > 0).select("own.*", "rejected")


def append_processed(df: DataFrame, path: str, schema: T.StructType = S.PROCESSED_TRANSACTION,
                     partition_col: str | None = "transaction_day", load_id: str | None = None) -> bool:
    """Append to a table with a fixed DDL, creating it when absent; empty input writes nothing. Rows that don't
    fit the DDL go to ``<path>_rejected`` with the columns and values that don't. Returns whether the table got rows.

    With ``load_id`` the append is idempotent: the load is a partition ``load_id=...`` of the table (instead of
    ``partition_col``) that a repeated load replaces as a whole; see ``replace_partitions``."""
    good, rejected = conform(df, schema)
    if load_id is not None:
        _replace_load(rejected, f"{path.rstrip('/')}_rejected", load_id)
        return _replace_load(good, path, load_id)
    if not rejected.isEmpty():
        rejected.write.mode("append").parquet(f"{path.rstrip('/')}_rejected")
    if good.isEmpty():
        return False
    w = good.write.mode("append")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)
    return True


def _replace_load(rows: DataFrame, path: str, load_id: str) -> bool:
    """Make the partition of a load hold exactly these rows; whether there are any. A load without rows only clears what an
    earlier attempt has left."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", load_id):
        raise ValueError("a load id has letters, digits, '_', '.' and '-' only")
    name = f"{path.rstrip('/')}/load_id={load_id}"
    if not path_exists(rows.sparkSession, name) and rows.isEmpty():  # looking for a first row may read them all
        return False
    replace_partitions(rows.withColumn("load_id", F.lit(load_id)), path, "load_id", [load_id])
    return path_exists(rows.sparkSession, name)


def read_loads(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all loads of a table that is appended to by load id."""
    whole = T.StructType([*schema.fields, T.StructField("load_id", T.StringType())])
    return read_lake(spark, path, whole).select(*schema.names)


def materialize(df: DataFrame, name: str, kind: str = "view", path: str | None = None) -> DataFrame:
    """A named model. ``view`` registers a temp view (staging); ``table`` writes it (marts) and
    returns the stored table, so later models read the materialized result, not the lineage."""
    spark = df.sparkSession
    if kind == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if kind == "table":
        if path:
            df.write.mode("overwrite").parquet(path)
            stored = spark.read.parquet(path)
            stored.createOrReplaceTempView(name)
            return stored
        df.write.mode("overwrite").saveAsTable(name)
        return spark.table(name)
    raise ValueError(f"unknown kind {kind!r}")


def append_transactions(df: DataFrame, path: str, load_id: str | None = None) -> DataFrame:
    """Insert new transaction rows after the stream's classification (T3). A row is ``invalid`` where the validity
    rule fails and ``error`` where a value doesn't fit its type; such rows are written to ``<path>_rejected`` with
    their reason and returned from there, so a later change of the input doesn't change them. With ``load_id`` a
    repeated load replaces itself instead of being added once more (as in ``append_processed``)."""
    from ledgerflow.functions.features import is_valid_transaction
    from ledgerflow.session import work_path

    spark = df.sparkSession
    fitted = _fitted(df, S.TRANSACTION)
    valid = F.coalesce(is_valid_transaction(fitted), F.lit(False))
    tagged = fitted.withColumn("reason", F.when(F.size("rejected") > 0, F.lit("error")).when(~valid, F.lit("invalid")))
    good = tagged.where("reason is null").select(*S.TRANSACTION.names)
    if load_id is None:
        good.write.mode("append").parquet(path)
    else:
        _replace_load(good, path, load_id)
    bad = tagged.where("reason is not null").select("own.*", "reason")
    out = work_path(spark, "rejected", unique=True)
    bad.write.parquet(out)
    stored = spark.read.schema(bad.schema).parquet(out)
    if load_id is None:
        stored.write.mode("append").parquet(f"{path.rstrip('/')}_rejected")
    else:
        _replace_load(stored, f"{path.rstrip('/')}_rejected", load_id)
    return stored
