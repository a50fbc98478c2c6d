"""Token counts: the exact histogram of encoded lengths, and suffix sums that answer for every context limit.

Documents are encoded in Arrow batches and only (length, documents) leaves a task, already added up per batch. Suffix
sums are taken in two levels, blocks of lengths and lengths within a block, so no window holds all lengths.

Edge cases: a null or empty text has length 0; repeated rows count as often as they stand; an empty table has an empty
histogram; ids, nulls in other columns and extra columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.encoder import worker_encoder

VOCABULARY = "byte_bpe_50k.json"
BLOCK = 1024  # lengths per block of the two-level sums


def length_counts(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs): documents of each encoded length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = worker_encoder(vocabulary), Counter()
        for b in batches:
            seen.update(len(x) // 4 for x in encode(b.column(0).to_pylist()))
        yield pa.record_batch([pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["length", "n_docs"])

    return docs.select(F.col(text_col)).mapInArrow(count, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Per distinct length L: documents and tokens of that length, of at least L and of at most L, and the tokens that
    remain when every document is cut at L."""
    rows = counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    blocks = blocks.select(
        "block", zero(F.sum("d").over(above)).alias("docs_above"), zero(F.sum("t").over(above)).alias("tokens_above"),
        F.sum("d").over(everything).alias("all_docs"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, "block").select(
        "length", "n_docs", "n_tokens", "all_docs",
        (F.sum("n_docs").over(within) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum("n_tokens").over(within) + F.col("tokens_above")).alias("tokens_at_least"),
    )
    all_tokens = F.col("tokens_at_least")
    below = F.col("all_docs") - F.col("docs_at_least")
    return rows.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (below + F.col("n_docs")).alias("docs_at_most"),
        # tokens lost by a cut at this length, over all longer documents
        (all_tokens - F.col("length") * F.col("docs_at_least")).alias("tokens_cut"),
    )


def histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The suffix sums of all documents; the counts, a row per distinct length, are kept so that texts are encoded once."""
    return suffix_sums(length_counts(docs, text_col, vocabulary).checkpoint())


def truncated_totals(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, n_docs, n_longer, n_tokens, n_kept_tokens): totals if every document is cut at the limit."""
    cols = []
    for c in limits:
        longer = F.col("length") > F.lit(c)
        cols.append(F.struct(
            F.lit(int(c)).cast("long").alias("context_limit"), F.sum("n_docs").alias("n_docs"), F.sum(F.when(longer, F.col("n_docs")).otherwise(0)).alias("n_longer"),
            F.sum("n_tokens").alias("n_tokens"), F.sum(F.least("length", F.lit(c)) * F.col("n_docs")).alias("n_kept_tokens"),
        ))
    return hist.agg(F.array(*cols).alias("x")).select(F.inline("x")).where("n_docs is not null")


def length_quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of the documents doesn't exceed."""
    total = F.sum("n_docs")
    whole = hist.agg(total.alias("total"))
    cols = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("docs_at_most") >= F.ceil(F.lit(float(q)) * F.col("total")), F.col("length"))).alias("length")) for q in shares]
    return hist.crossJoin(F.broadcast(whole)).agg(F.array(*cols).alias("x")).select(F.inline("x")).where("length is not null")
