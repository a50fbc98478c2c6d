"""Cross-tokenizer alignment: which tokens of two tokenizers cover common bytes, per document and corpus-wide.

Both tokenizers cut the same bytes (a space and the text), so every token is a byte range. Per batch of documents a
``merge_asof`` keyed by document gives each token start of one side the other side's token that covers it; the union
of both directions is every overlapping pair of occurrences (of two ranges that overlap, one starts inside the other).
Offsets where tokens of both sides end cut a document into groups.

A pair of ids counts how many overlaps of the corpus hold it. A document's distinct pairs and how often it has each
are kept packed beside its row; their counts are added up in the workers, then over the corpus. The pairs are then looked up:
the HOT_PAIRS most frequent ones, a bound on rows, are broadcast as sorted arrays, and all others, which are few per
document and none of which is frequent, meet their counts in a join.

Edge cases: a null or empty text, or one whose bytes a tokenizer doesn't give back (a U+2581 in it), has no tokens: zeros and
an empty digest; special tokens' strings are plain text; rows with equal ids or texts are documents each; a null id stays
null; very long texts are aligned whole, in memory in proportion to the text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import staged_at
from ledgerflow.llm.encoder import OTHERS, PieceEncoder, WordMemoEncoder, byte_level_bytes, frequent_ids, piece_bytes, public_path, word_keys

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
FREQUENT_WORDS = 1 << 18
HOT_PAIRS = 1 << 20
BATCH_BYTES = 1 << 20  # of text that is aligned at a time
HELD_PAIRS = 1 << 21  # distinct pairs that a task adds up at a time
B_BITS = 16  # a pair is a's id << 16 | b's id


class _Side:
    """Bytes of a tokenizer's ids as flat arrays, and their decimal forms with either separator."""

    def __init__(self, pieces: list[bytes], separators: str):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces) + b"\0", np.uint8)
        width = len(str(len(pieces))) + 1
        self.decimal = np.array([[f"{i}{s}".encode() for s in separators] for i in range(len(pieces))], f"S{width}")

    def content(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        skip = self.at[ids] - (np.cumsum(size) - size)
        return self.flat[np.repeat(skip, size) + np.arange(int(size.sum()))]


@dataclass
class Aligned:
    """Tokens of several documents in order; ``doc`` is a document's place in the batch.

    a, b: frames of doc, id, start, end (offsets in the batch's bytes) and group (numbered over the batch);
    links: places in a and b of every overlapping pair of tokens.
    """

    a: pd.DataFrame
    b: pd.DataFrame
    link_a: np.ndarray
    link_b: np.ndarray
    group_doc: np.ndarray


class Aligner:
    """Both tokenizers and their tables, in a worker."""

    def __init__(self, side_a: str = SIDE_A, side_b: str = SIDE_B, frequent: list[dict[str, bytes]] | None = None, memo: int = OTHERS):
        a, b = public_path(side_a), public_path(side_b)
        own = frequent or [{}, {}]
        self.encode_a, self.encode_b = WordMemoEncoder(a, memo, own[0]), PieceEncoder(b, memo, own[1])
        self.a, self.b = _Side(byte_level_bytes(a), ",|"), _Side(piece_bytes(b), ",;")

    def _tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side: document and id of each token, of the documents whose bytes both sides give back."""
        wanted = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        sides, keys = [], word_keys(texts)
        for encode, side in ((self.encode_a, self.a), (self.encode_b, self.b)):
            ids = encode(texts, True, keys)
            width = np.dtype(encode.dtype).itemsize
            sides.append((np.repeat(np.arange(len(ids)), [len(x) // width for x in ids]), np.frombuffer(b"".join(ids), encode.dtype).astype(np.int64), side))
        sizes = np.array([len(w) for w in wanted], np.int64)
        whole = np.ones(len(texts), bool)
        for doc, ids, side in sides:
            whole &= np.bincount(doc, side.size[ids], minlength=len(texts)).astype(np.int64) == sizes
        there = np.frombuffer(b"".join(w for w, ok in zip(wanted, whole) if ok), np.uint8)
        byte_doc = np.repeat(np.arange(len(texts)), np.where(whole, sizes, 0))
        equal = whole.copy()
        for doc, ids, side in sides:
            equal[byte_doc[side.content(ids[whole[doc]]) != there]] = False
        return [(doc[equal[doc]], ids[equal[doc]]) for doc, ids, _ in sides]

    def align(self, texts: list[str | None]) -> Aligned:
        frames = []
        for (doc, ids), side in zip(self._tokens(texts), (self.a, self.b)):
            end = np.cumsum(side.size[ids])
            frames.append(pd.DataFrame({"doc": doc, "id": ids, "start": end - side.size[ids], "end": end}))
        a, b = frames
        if not len(a):
            none = np.zeros(0, np.int64)
            return Aligned(a.assign(group=none), b.assign(group=none), none, none, none)
        over, back = covering(a, b), covering(b, a)
        more = np.flatnonzero(b["start"].to_numpy() != a["start"].to_numpy()[back])  # equal starts are in the first direction
        cuts = np.intersect1d(a["end"].to_numpy(), b["end"].to_numpy(), assume_unique=True)
        for f in frames:
            f["group"] = np.searchsorted(cuts, f["end"].to_numpy())
        group_doc = a["doc"].to_numpy()[np.searchsorted(a["end"].to_numpy(), cuts)]
        return Aligned(a, b, np.concatenate((np.arange(len(a)), back[more])), np.concatenate((over, more)), group_doc)

    def rendered(self, x: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """The groups' text ``a1,a2|b1;a3|b2,b3`` of all documents as fixed-width pieces in order, and their documents."""
        sides = []
        for f, other, side in ((x.a, x.b, self.a), (x.b, x.a, self.b)):
            group = f["group"].to_numpy()
            last = np.ones(len(f), np.int64)
            last[:-1] = group[1:] != group[:-1]
            # tokens of the other side that come before: of earlier groups, and of the own one before b's
            before = np.searchsorted(other["group"].to_numpy(), group, "left" if f is x.a else "right")
            sides.append((np.arange(len(f)) + before, side.decimal[f["id"].to_numpy(), last], f["doc"].to_numpy()))
        width = max(s[1].dtype.itemsize for s in sides)
        total = sum(len(s[0]) for s in sides)
        pieces, doc = np.zeros(total, f"S{width}"), np.zeros(total, np.int64)
        for place, text, own in sides:
            pieces[place], doc[place] = text, own
        return pieces, doc


def covering(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Per token of ``left``, the place in ``right`` of the token of the same document that covers its start."""
    found = pd.merge_asof(left[["doc", "start"]], right[["doc", "start"]].assign(place=np.arange(len(right))), on="start", by="doc")
    return found["place"].to_numpy()


def _slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text; a row longer than that is one of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    lo = 0
    while lo < batch.num_rows:
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


_ALIGNERS: dict[tuple, Aligner] = {}


def _worker_aligner(side_a: str, side_b: str, shared) -> Aligner:
    key = (side_a, side_b, shared.id if shared is not None else None)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(side_a, side_b, None if shared is None else shared.value)
    return _ALIGNERS[key]


class _Shared:
    """A broadcast and a name under which a worker keeps what it makes of it."""

    def __init__(self, spark: SparkSession, value):
        import uuid

        self.id, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.broadcast.value


def _frequent(docs: DataFrame, text_col: str, side_a: str, side_b: str, most: int) -> _Shared | None:
    if most < 1:
        return None

    def encoders():
        x = _worker_aligner(side_a, side_b, None)
        return [x.encode_a, x.encode_b]

    return _Shared(docs.sparkSession, frequent_ids(docs, text_col, encoders, most))


def alignments(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, frequent_words: int = FREQUENT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_groups, b_groups, links) per document: both sides' ids, the group of each token (from 0) and
    the overlapping pairs as (place in a_ids, place in b_ids)."""
    shared = _frequent(docs, text_col, side_a, side_b, frequent_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _worker_aligner(side_a, side_b, shared)
        for batch in batches:
            for some in _slices(batch, "text"):
                x = aligner.align(some.column("text").to_pylist())
                n = np.arange(some.num_rows + 1)
                at = {k: np.searchsorted(f["doc"].to_numpy(), n).astype(np.int32) for k, f in (("a", x.a), ("b", x.b))}
                first_group = np.searchsorted(x.group_doc, n[:-1])
                lists = {}
                for k, f in (("a", x.a), ("b", x.b)):
                    lists[f"{k}_ids"] = pa.ListArray.from_arrays(at[k], pa.array(f["id"].to_numpy().astype(np.int32)))
                    lists[f"{k}_groups"] = pa.ListArray.from_arrays(at[k], pa.array((f["group"].to_numpy() - first_group[f["doc"].to_numpy()]).astype(np.int32)))
                order = np.lexsort((x.link_b, x.link_a))
                doc = x.a["doc"].to_numpy()[x.link_a[order]]
                pair = pa.StructArray.from_arrays([pa.array((x.link_a[order] - at["a"][doc]).astype(np.int32)), pa.array((x.link_b[order] - at["b"][doc]).astype(np.int32))], names=["a", "b"])
                lists["links"] = pa.ListArray.from_arrays(np.searchsorted(doc, n).astype(np.int32), pair)
                names = ["a_ids", "b_ids", "a_groups", "b_groups", "links"]
                yield pa.record_batch([some.column("doc_id"), *[lists[k] for k in names]], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, links array<struct<a:int,b:int>>")


SUMMARY = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def summaries(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, frequent_words: int = FREQUENT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its counts, the digest of its groups, its distinct pairs (sorted, as packed unsigned 32-bit integers) and
    how many links hold each."""
    shared = _frequent(docs, text_col, side_a, side_b, frequent_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _worker_aligner(side_a, side_b, shared)
        for batch in batches:
            for some in _slices(batch, "text"):
                x, n = aligner.align(some.column("text").to_pylist()), some.num_rows
                pieces, piece_doc = aligner.rendered(x)
                cut = np.searchsorted(piece_doc, np.arange(n + 1))
                sha = [hashlib.sha256(pieces[lo:hi].tobytes().translate(None, b"\0")[:-1]).hexdigest() if hi > lo else "" for lo, hi in zip(cut, cut[1:])]
                link_doc = x.a["doc"].to_numpy()[x.link_a]
                key = link_doc << 32 | x.a["id"].to_numpy()[x.link_a] << B_BITS | x.b["id"].to_numpy()[x.link_b]
                distinct, times = np.unique(key, return_counts=True)
                at = np.searchsorted(distinct, np.arange(n + 1) << 32)
                pairs, times = distinct.astype("<u4"), times.astype("<u4")
                count = lambda doc: pa.array(np.bincount(doc, minlength=n))
                yield pa.record_batch([
                    some.column("row"), some.column("doc_id"), count(x.a["doc"]), count(x.b["doc"]), count(x.group_doc), count(link_doc), pa.array(sha, pa.string()),
                    pa.array([pairs[lo:hi].tobytes() for lo, hi in zip(at, at[1:])], pa.binary()), pa.array([times[lo:hi].tobytes() for lo, hi in zip(at, at[1:])], pa.binary()),
                ], names=[f.split()[0] for f in SUMMARY.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SUMMARY)


def pair_counts(packed: DataFrame) -> DataFrame:
    """(pair, n, best): the links that hold each pair, and whether no pair of the same b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate(keys), return_inverse=True)
            return keys, np.bincount(place, np.concatenate(counts)).astype(np.int64)

        def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys), 1 << 16):
                yield pa.record_batch([pa.array(keys[lo : lo + (1 << 16)].astype(np.int64)), pa.array(counts[lo : lo + (1 << 16)])], names=["pair", "n"])

        held, new, size = (np.zeros(0, np.uint32), np.zeros(0, np.int64)), [], 0
        for b in batches:
            for pairs, times in zip(*(c.to_pylist() for c in b.columns)):
                new.append((np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)))
                size += len(pairs) // 4
                if size >= HELD_PAIRS:
                    held, new, size = added(*map(list, zip(held, *new))), [], 0
                    if len(held[0]) >= HELD_PAIRS:
                        yield from rows(*held)
                        held = (held[0][:0], held[1][:0])
        if new or len(held[0]):
            yield from rows(*added(*map(list, zip(held, *new))))

    counts = packed.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1).cast("long")))))


def _hot_pairs(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent pairs, at most ``most`` (all of at least some count), and all others."""
    stepped = counts.withColumn("step", F.floor(F.log2("n") * 16).cast("int"))
    least, total = None, 0
    for step, n in stepped.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 16 * 64 rows
        total += n
        if total > most:
            break
        least = step
    hot = F.lit(False) if least is None else F.col("step") >= least
    return stepped.where(hot).drop("step"), stepped.where(~hot).drop("step")


def report(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, frequent_words: int = FREQUENT_WORDS, hot_pairs: int = HOT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    spark = docs.sparkSession
    summary, _ = staged_at(summaries(docs, side_a, side_b, frequent_words, id_col, text_col), "alignments", compression="zstd")
    counts, _ = staged_at(pair_counts(summary), "pair_counts")
    hot, rest = _hot_pairs(counts, hot_pairs)
    table = hot.toArrow()
    pair = table.column("pair").to_numpy()
    order = np.argsort(pair)
    shared = spark.sparkContext.broadcast((pair[order].astype(np.uint32), table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted, best = shared.value
        for b in batches:
            rows = [[], [], [], []]
            for pairs, times in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist()):
                pairs, times = np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
                place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                there = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
                at, t = place[there], times[there]
                for column, value in zip(rows, (int(t[best[at]].sum()), int((t * counted[at]).sum()), pairs[~there].astype(np.int64), times[~there])):
                    column.append(value)
            own = [b.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            more = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.list_(pa.int64()))]
            yield pa.record_batch([*own, *more], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "times"])

    found = summary.mapInArrow(look_up, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>")
    found, _ = staged_at(found, "aligned", compression="zstd")
    left = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    more = left.join(rest, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = found.drop("pairs", "times").join(more, "row", "left")
    return both.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
