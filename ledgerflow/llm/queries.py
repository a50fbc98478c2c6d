"""The registered queries of this package: one per operator, over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import bloom_lm, byte_bpe, decontaminate, filter_audit, host_trust, length_histogram, line_templates, near_join, tag_paths, token_alignment, token_frames, toxicity, weak_quality

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_trust.judge_urls(table(spark, sf_dir, "pages"))


def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.judge(table(spark, sf_dir, "documents"))


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.round_trip(table(spark, sf_dir, "documents"), plain_specials=False)


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.histogram(table(spark, sf_dir, "documents"))


def op8_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract(table(spark, sf_dir, "pages"))


def op9_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_words=1)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_repeated_lines(docs, fields=None, min_tokens=1).select("doc_id", "n_lines", "n_dropped", "text")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.report(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_host_trust, op2_bloom_lm, op3_byte_bpe, op4_weak_quality, op5_near_join, op6_token_frames, op7_length_histogram, op8_tag_paths, op9_pigeonhole, op10_line_templates, op11_toxicity, op12_token_alignment, op13_filter_audit)}
ORACLE: dict[str, str] = {"op1_host_trust": host_trust.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
