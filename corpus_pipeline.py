"""The corpus pipeline: quality rules, line dedup, near copies, benchmark decontamination, byte-level BPE.

Each stage works on all that the one before kept and is written as Parquet to the shared folder before the next reads
it, so a lost executor costs no more than its part of one stage. All but the last return the columns of documents.

Edge cases, as the operators' docstrings say them for each stage: a null, empty or short text fails the base rule and goes in
the first stage; a later stage that is given such texts keeps them. Texts of any length are worked on whole. Null ids count as
the smallest for lines and the last among copies; rows equal in id and text stay or go together. An empty table gives no
rows. Columns beyond those of documents, whatever their names, are kept up to the last stage, n_chars follows the text
where it is there, and the last stage returns its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import byte_bpe, decontaminate, line_templates, near_join, weak_quality
from ledgerflow.llm.common import free_name, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps."""
    return weak_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat templates of earlier documents; n_chars follows the text."""
    counts = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    out = line_templates.drop_repeated_lines(docs, counts=counts)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return near_join.drop_near_copies(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its number of tokens and digests of its ids and of what they decode to."""
    return byte_bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

# line templates, components of links and merges by rank are beyond SQL; tests hold run() against a brute-force version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
