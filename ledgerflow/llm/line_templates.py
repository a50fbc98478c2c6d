"""Line dedup by a fixed-depth template tree, as log parsers have it.

A line's place in the tree is its token count and its leading tokens, where tokens with digits count as variable. The
line's tokens are dealt to at most FIELDS fields, each a stretch of tokens and so a single token in short lines. Within
a leaf, a field value that stands at the same place in lines of other documents is part of the leaf's template, and any
other value is variable. A line repeats a template of earlier documents where fields with at least ``similarity`` of
its tokens stand in a document of smaller id and in enough documents in all: ``few_documents`` for lines of at least
``long_line`` tokens, ``min_documents`` for shorter ones. Such lines are dropped; the first document keeps its own.

With ``fields=None`` every token is a field, so one variable word costs one token, however long the line is; that is what
the query op10 runs, with lines of one token and more. Then equal lines count as one variant of their leaf. Of a variant's
tokens, each stands in earlier documents from some first document on; the line repeats in the documents after the one
from which on enough of its tokens do, and so one number per variant decides for all documents that hold it.

The tree is never held anywhere: places are hashes, and a leaf's template is what a count per (leaf, field, value)
says, added up before the shuffle. So no leaf, however full, comes to one task, and the result doesn't depend on any
order of arrival. Only lines in leaves of two documents or more go on past the first count. A value in very many
documents makes a large key of the second join; adaptive execution splits it, as it feeds no grouping in place.

Edge cases: a null text stays null and an empty one empty; lines without a token, or of fewer than ``min_tokens``, are
kept; repeats within one document, and rows with equal ids, are not dropped for each other; a null id comes before all;
a document may end up empty, its row stays; a line of any length is one line, and a text of any length is parsed whole; an
empty table gives no rows; all other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Words, free_name, mix64, staged

DEPTH = 3  # leading tokens
FIELDS = 8
SIMILARITY = 0.8
MIN_TOKENS, LONG_LINE = 3, 10
FEW_DOCUMENTS, MIN_DOCUMENTS = 2, 5
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_VARIABLE = np.uint64(0x5851F42D4C957F2D)


def _lines_of(texts: list[str | None], depth: int, min_tokens: int) -> dict[str, np.ndarray]:
    """Lines with at least ``min_tokens`` tokens: doc and line (their indices), first (of their tokens), tokens (their number) and
    leaf; token: hashes of all tokens, total: their running sum, weighed by the place in the line."""
    w = Words(texts)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[w.buf])))
    token = np.where(digits[w.end] > digits[w.start], _VARIABLE, w.hash)
    feeds = np.concatenate(([0], np.cumsum(w.buf == 10)))
    line = feeds[w.start]  # over the whole buffer; texts are parted by a line feed, so no line spans two
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    starts = first
    count = np.diff(np.concatenate((first, [len(line)])))
    some = count >= max(1, min_tokens)
    first, count = first[some], count[some]
    doc = w.doc[first]
    doc_feeds = np.concatenate(([0], feeds[w.byte_ends]))
    with np.errstate(over="ignore"):
        leaf = mix64(count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k in range(depth):
            at = np.minimum(first + k, len(token) - 1)
            leaf = np.where(count > k, mix64(leaf * np.uint64(0xC2B2AE3D27D4EB4F) + token[at]), leaf)
        # the hash of a stretch: its tokens weighed by their place in the line, summed
        place = np.arange(len(token)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(token)]))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(token + place.astype(np.uint64) * np.uint64(0x165667B19E3779F9)), dtype=np.uint64)))
    return {"doc": doc, "line": line[first] - doc_feeds[doc], "first": first, "tokens": count, "leaf": leaf, "token": token, "total": total}


def parse_lines(texts: list[str | None], depth: int = DEPTH, fields: int = FIELDS, min_tokens: int = MIN_TOKENS) -> dict[str, np.ndarray]:
    """Lines with at least ``min_tokens`` tokens: doc and line (their indices), tokens, leaf, and per field a hash of
    (leaf, place, value) and the number of its tokens (0: the line has no such field)."""
    p = _lines_of(texts, depth, min_tokens)
    first, count, leaf, total = p["first"], p["tokens"], p["leaf"], p["total"]
    keys, sizes = [], []
    with np.errstate(over="ignore"):
        for k in range(fields):
            lo, hi = first + count * k // fields, first + count * (k + 1) // fields
            keys.append(mix64(mix64(leaf + np.uint64(k + 1)) + (total[hi] - total[lo])))
            sizes.append(hi - lo)
    n = len(first)
    return {k: p[k] for k in ("doc", "line", "tokens", "leaf")} | {"keys": np.stack(keys, 1) if n else np.zeros((0, fields), np.uint64), "sizes": np.stack(sizes, 1) if n else np.zeros((0, fields), np.int64)}


def parsed(docs: DataFrame, depth: int, fields: int, min_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, line, tokens, leaf, keys, sizes): row tells documents with equal ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                p = parse_lines(some.column(2).to_pylist(), depth, fields, min_tokens)
                keep = p["sizes"] > 0
                ends = np.concatenate(([0], np.cumsum(keep.sum(axis=1)))).astype(np.int32)
                as_list = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
                doc = pa.array(p["doc"], pa.int64())
                yield pa.record_batch([
                    some.column(0).take(doc), some.column(1).take(doc), pa.array(p["line"], pa.int32()), pa.array(p["tokens"], pa.int32()),
                    pa.array(p["leaf"].view(np.int64)), as_list(p["keys"][keep].view(np.int64)), as_list(p["sizes"][keep].astype(np.int32)),
                ], names=["row", "doc_id", "line", "tokens", "leaf", "keys", "sizes"])

    rows = docs.select(_row(id_col, text_col).alias("row"), _order(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, line int, tokens int, leaf long, keys array<long>, sizes array<int>")


def _row(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _order(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))


def repeated_lines(
    docs: DataFrame, similarity: float = SIMILARITY, min_documents: int = MIN_DOCUMENTS, few_documents: int = FEW_DOCUMENTS, long_line: int = LONG_LINE,
    depth: int = DEPTH, fields: int = FIELDS, min_tokens: int = MIN_TOKENS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(row, lines): per document with any, the indices of the lines that repeat templates of earlier documents."""
    lines = staged(parsed(docs, depth, fields, min_tokens, id_col, text_col), "lines")
    shared = lines.groupBy("leaf").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("leaf")
    lines = staged(lines.join(shared, "leaf", "left_semi"), "lines_of_shared_leaves")
    parts = lines.select("row", "doc_id", "line", "tokens", F.explode(F.arrays_zip("keys", "sizes")).alias("x")).select("row", "doc_id", "line", "tokens", F.col("x.keys").alias("key"), F.col("x.sizes").alias("size"))
    # a document counts once for a value, however many of its lines have it
    values = (
        parts.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key")
        .agg(F.min("doc_id").alias("first_doc"), F.sum("one").alias("n_docs")).where(F.col("n_docs") >= min(few_documents, min_documents))
    )
    need = F.when(F.col("tokens") >= long_line, few_documents).otherwise(min_documents)
    seen = parts.join(values, "key").where((F.col("first_doc") < F.col("doc_id")) & (F.col("n_docs") >= need))
    by_line = seen.groupBy("row", "line", "tokens").agg(F.sum("size").alias("seen"))
    return by_line.where(F.col("seen") >= F.lit(similarity) * F.col("tokens")).groupBy("row").agg(F.collect_list("line").alias("lines"))


def _whole(p: dict[str, np.ndarray]) -> np.ndarray:
    """Hashes of leaf and line."""
    with np.errstate(over="ignore"):
        return mix64(mix64(p["leaf"]) + p["total"][p["first"] + p["tokens"]] - p["total"][p["first"]]).view(np.int64)


def _hashed_lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(row, doc_id, line, tokens, leaf, whole) of documents (row, doc_id, text): a line's place and hashes, not its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                p = _lines_of(some.column(2).to_pylist(), depth, min_tokens)
                doc = pa.array(p["doc"], pa.int64())
                yield pa.record_batch([
                    some.column(0).take(doc), some.column(1).take(doc), pa.array(p["line"], pa.int32()), pa.array(p["tokens"], pa.int32()), pa.array(p["leaf"].view(np.int64)), pa.array(_whole(p)),
                ], names=["row", "doc_id", "line", "tokens", "leaf", "whole"])

    return docs.mapInArrow(run, "row long, doc_id long, line int, tokens int, leaf long, whole long")


def _words_of(docs: DataFrame, wanted: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(whole, words): 32 bits of each token's hash, for the wanted lines (row, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                p = _lines_of(some.column(0).to_pylist(), depth, min_tokens)
                asked = {(d, x) for d, own in enumerate(some.column(1).to_pylist()) for x in own}
                keep = np.array([x in asked for x in zip(p["doc"].tolist(), p["line"].tolist())], bool)
                first, count = p["first"][keep], p["tokens"][keep]
                ends = np.concatenate(([0], np.cumsum(count)))
                own = np.arange(ends[-1]) + np.repeat(first - ends[:-1], count)
                words = pa.array((p["token"][own] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.record_batch([pa.array(_whole(p)[keep]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words)], names=["whole", "words"])

    by_row = wanted.groupBy("row").agg(F.collect_list("line").alias("lines"))
    return docs.select("row", "text").join(by_row, "row").select("text", "lines").mapInArrow(run, "whole long, words array<int>")


def _values(lines: DataFrame, *columns: str) -> DataFrame:
    """Per token of a line a key of (leaf, place, token)."""
    words = lines.select("leaf", *columns, F.posexplode("words").alias("place", "word"))
    return words.select(*columns, F.xxhash64("leaf", "place", "word").alias("key"))


def _first_documents(per: DataFrame, variants: DataFrame, need: int) -> DataFrame:
    """(key, first_doc): values that stand in ``need`` documents or more, with the smallest id. Two documents are what any
    document after the first asks for, so there the variants' own first documents tell all; else documents are counted."""
    if need <= 2:
        return _values(variants, "first_doc").groupBy("key").agg(F.min("first_doc").alias("first_doc"))
    lines = per.select("whole", "doc_id").join(variants.select("whole", "leaf", "words"), "whole")
    each = _values(lines, "doc_id").groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return each.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.sum("one").alias("n")).where(F.col("n") >= need).drop("n")


def repeated_lines_by_token(
    docs: DataFrame, similarity: float = SIMILARITY, min_documents: int = MIN_DOCUMENTS, few_documents: int = FEW_DOCUMENTS, long_line: int = LONG_LINE,
    depth: int = DEPTH, min_tokens: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """As ``repeated_lines``, every token a field.

    Most lines are alone in their leaf, or with equal ones only, which their hashes tell: there all tokens stand in the same
    documents. Tokens are looked at for one line of each variant in the leaves that hold several."""
    rows = docs.select(_row(id_col, text_col).alias("row"), _order(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = staged(_hashed_lines(rows, depth, min_tokens), "lines")
    per = lines.groupBy("whole", "doc_id").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"), F.min(F.struct("row", "line")).alias("at"))
    variants = per.groupBy("whole").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"), F.min("at").alias("at"))
    leaves = variants.groupBy("leaf").agg(F.count("*").alias("n_variants"), F.min("first_doc").alias("a"), F.max("last_doc").alias("b")).where("a < b").select("leaf", "n_variants")
    variants = staged(variants.join(leaves, "leaf"), "variants")

    is_long = F.col("tokens") >= long_line
    alone = variants.where((F.col("n_variants") == 1) & (F.col("n_docs") >= F.when(is_long, few_documents).otherwise(min_documents)))
    several = variants.where("n_variants > 1")
    words = _words_of(rows, several.select("at.*"), depth, min_tokens).groupBy("whole").agg(F.first("words").alias("words"))  # rows may repeat
    several = staged(several.select("whole", "leaf", "tokens", "first_doc").join(words, "whole"), "variants_of_full_leaves")
    first = _first_documents(lines.where(is_long).select("whole", "doc_id").distinct(), several.where(is_long), few_documents).unionByName(
        _first_documents(lines.where(~is_long).select("whole", "doc_id").distinct(), several.where(~is_long), min_documents))
    wanted = F.ceil(F.lit(similarity) * F.col("tokens") - 1e-9).cast("int")
    after = (
        _values(several, "whole", "tokens").join(first, "key").groupBy("whole", "tokens").agg(F.sort_array(F.collect_list("first_doc")).alias("firsts"))
        .where(F.size("firsts") >= wanted).select("whole", F.get("firsts", F.greatest(wanted, F.lit(1)) - 1).alias("after"))
        .unionByName(alone.select("whole", F.col("first_doc").alias("after")))
    )
    gone = lines.select("row", "doc_id", "line", "whole").join(after, "whole").where("doc_id > after")
    return gone.groupBy("row").agg(F.collect_list("line").alias("lines"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fields: int | None = FIELDS, counts: tuple[str, str] = ("n_lines", "n_dropped"), **how
) -> DataFrame:
    """All documents with all their columns, their texts without the repeated lines, and the numbers of lines and of dropped
    ones (long) after them, by the names in ``counts``; columns of these names in the input are replaced."""
    find = repeated_lines_by_token if fields is None else lambda *a, **k: repeated_lines(*a, fields=fields, **k)
    own = docs.drop(*counts)
    row, at_lines = free_name(own, "_row"), free_name(own, "_lines")
    lines = find(docs, id_col=id_col, text_col=text_col, **how).select(F.col("row").alias(row), F.col("lines").alias(at_lines))
    joined = own.withColumn(row, _row(id_col, text_col)).join(lines, row, "left").select(*[F.col(f"`{c}`") for c in own.columns], at_lines)
    at = own.columns.index(text_col)
    out = own.schema.add(counts[0], "long").add(counts[1], "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, dropped = [], [], []
            for t, gone in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                own_lines = [] if t is None else t.split("\n")
                if gone:
                    away = set(gone)
                    t = "\n".join([x for i, x in enumerate(own_lines) if i not in away])
                texts.append(t)
                counts.append(len(own_lines))
                dropped.append(len(set(gone)) if gone else 0)
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.record_batch([*cols, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=out.names)

    return joined.mapInArrow(run, out)
