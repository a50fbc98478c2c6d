"""Language-model scores from a log-frequency Bloom filter that is broadcast to the workers.

The model is a bigram model. A count c is kept as its level ``1 + floor(log2 c)`` by putting (n-gram, 1) to (n-gram,
level) into a Bloom filter; a count is read by probing levels 1, 2, ... until one is missing, and the level's expected
count is taken. The probability of a word w after v mixes the bigram estimate with the smoothed unigram one,

    p(w | v) = l * min(1, c(v w) / c(v)) + (1 - l) * (c(w) + 0.1) / (N + 0.1 * (V + 1)),

where l = C / (C + T) over all contexts of v's level, C their counts and T their distinct followers (Witten-Bell
smoothing per level). A text starts after a start mark and ends with the end token.

Steps: (1) exact counts of all tokens, (2) the unigrams' filter, (3) bigram counts, merged per bucket of hashes into the
bigrams' filter, (4) scores. Tasks add up the counts of what they read and send them per bucket as packed arrays, so a
word in every text is one entry per task. A filter is as many small filters as there are buckets, each sized by its own
n-grams at BITS bits per entry; no n-gram is left out, however large the corpus.

While the filters are expected to fit in ``max_filter_bytes`` (they never take twice that) they are broadcast. A larger
corpus is cut into chunks of about CHUNK bytes of text instead (``score_in_chunks``): a chunk asks each bucket for the
levels of its distinct n-grams, the bucket's filter is probed where it stands, and the answers meet the chunk's texts by
a shuffle. The filters are the same ones, so the scores are the same; nothing is broadcast then, and the driver gets two
short arrays from each task. A hot n-gram is asked for once per chunk.

The base score is exact. Words that make up more than 1 / HOT of all tokens are fewer than HOT and their counts are
broadcast; occurrences of all others meet their counts by a shuffle on the word's bucket, packed as well. Chunks get the
counts of their words with the levels.

Words are compared by 64-bit hashes. Edge cases: a null text is empty and scores its end token; a null id is never held
out; repeated rows are counted and scored each; texts of any length are scored whole; with no training text, counts are
0 and base_score divides by 0.1 * (V + 1) = 0.1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Words, input_bytes, mix64, next_pow2, staged
from ledgerflow.llm.near_join import _groups

START, END = np.uint64(0x53A3F38D1C7E5A11), np.uint64(0xE4DE7D1C5B1F9A07)
HOT = 1 << 20
BITS, PROBES, LEVELS = 8, 4, 48
MAX_FILTER_BYTES = 128 << 20
FLUSH = 2_000_000  # distinct n-grams that a task holds before it sends them
TEXTS = 500
CHUNK = 8 << 20  # bytes of text
NEW_ENTRIES = 0.5  # expected bytes of the bigrams' filter per training token (check_l 0.51, sf0.1 0.72), never over 1
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def level(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.frexp(count.astype(float))[1], 0)


def expected(levels: np.ndarray) -> np.ndarray:
    """Mean of the counts 2^(q-1) .. 2^q - 1 of level q; 0 for level 0."""
    return np.where(levels > 0, (2.0 ** (levels - 1) + 2.0**levels - 1) / 2, 0.0)


@dataclass
class LogFrequencyFilter:
    """Bloom filters of all buckets in one array of bytes; bucket b has the bytes from starts[b] to starts[b + 1]."""

    shift: int
    starts: np.ndarray
    bits: np.ndarray

    @staticmethod
    def places(keys: np.ndarray, lev: int, size: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix64(keys + np.uint64(lev) * _C1)
            step = mix64(h ^ _C2) | np.uint64(1)
            for k in range(PROBES):
                yield ((h + np.uint64(k) * step) >> np.uint64(8)) % size

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, max_bytes: int | None = None) -> bytes:
        """The filter of one bucket. A caller may hold it to ``max_bytes``, which leaves out the rarest counts; the model
        never does."""
        q = level(counts)
        while max_bytes is not None and len(q) and q.sum() * BITS > max_bytes * 8:
            keep = q > q.min()
            keys, q = keys[keep], q[keep]
        size = max(1, -(-int(q.sum()) * BITS // 8)) if len(q) else 0
        out = np.zeros(size, np.uint8)
        for lev in range(1, int(q.max()) + 1 if len(q) else 1):
            own = keys[q >= lev]
            for at in cls.places(own, lev, np.uint64(size * 8)):
                np.bitwise_or.at(out, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        return out.tobytes()

    @classmethod
    def of_bucket(cls, keys: np.ndarray, counts: np.ndarray) -> LogFrequencyFilter:
        """The same filter by itself, for keys of its bucket only."""
        bits = np.frombuffer(cls.build(keys, counts), np.uint8)
        return cls(64, np.array([0, len(bits)]), bits)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key's count, by probing level after level."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.bits):
            return out
        bucket = (keys >> np.uint64(self.shift)).astype(np.int64)
        start = self.starts[bucket]
        size = (self.starts[bucket + 1] - start).astype(np.uint64) * np.uint64(8)
        active = np.flatnonzero(size)
        for lev in range(1, LEVELS):
            if not len(active):
                break
            there = np.ones(len(active), bool)
            for at in self.places(keys[active], lev, size[active]):
                there &= (self.bits[start[active] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            active = active[there]
            out[active] = lev
        return out


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first token of each text): all words with the end token after each text's last one."""
    w = Words(texts, lower=True)
    n = len(texts)
    first = w.first + np.arange(n + 1)
    h, doc = np.full(first[-1], END, np.uint64), np.repeat(np.arange(n), np.diff(first))
    own = np.ones(len(h), bool)
    own[first[1:] - 1] = False
    h[own] = w.hash
    return h, doc, first


def _before(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    v = np.empty_like(h)
    v[1:] = h[:-1]
    v[first[:-1]] = START
    return v


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """48 bits of a hash of each pair, in the upper end: pairs only feed the filter, which errs far more often."""
    with np.errstate(over="ignore"):
        return mix64(v * _C1 + w * _C2 + np.uint64(1)) & ~np.uint64(0xFFFF)


def _short(keys: np.ndarray) -> np.ndarray:
    """The upper six bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Add up (keys, count, ...) parts; the last column of ``keep`` parts is the same for equal keys."""
    keys = np.concatenate([p[0] for p in parts])
    unique, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    sums = [np.bincount(inverse, weights=np.concatenate([p[k] for p in parts]), minlength=len(unique)).astype(np.int64) for k in (1, 2)]
    extra = [np.concatenate([p[k] for p in parts])[at] for k in range(3, len(parts[0]))]
    return unique, *sums, *extra


_PACKED = "bucket int, keys binary, a binary, b binary"


def _packed(merged: tuple[np.ndarray, ...], shift: int, kinds: tuple[str, str], short: bool = False) -> pa.RecordBatch:
    """One row per bucket; keys ascend, so buckets do. short: keys go without their two lower bytes, which are 0."""
    keys, a, b = merged[:3]
    bucket = (keys >> np.uint64(shift)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keys) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(keys))
    cut = lambda x, kind: pa.array([x[lo:hi].astype(kind).tobytes() for lo, hi in zip(first, last)], pa.binary())
    packed = pa.array([_short(keys[lo:hi]).tobytes() for lo, hi in zip(first, last)], pa.binary()) if short else cut(keys, "<u8")
    return pa.record_batch([pa.array(bucket[first], pa.int32()), packed, cut(a, kinds[0]), cut(b, kinds[1])], names=["bucket", "keys", "a", "b"])


def _collected(df: DataFrame, fields: str, unpack, reduce) -> DataFrame:
    """Bring the packed rows of each bucket together and reduce them to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 1):
            yield reduce(g.column("bucket")[0].as_py(), unpack(g))

    return df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, fields)


def _arrays(g: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in g.column(column).to_pylist()]


@dataclass
class Model:
    unigrams: LogFrequencyFilter
    bigrams: LogFrequencyFilter
    weight: np.ndarray  # l of each context level
    n: int
    v: int
    hot_keys: np.ndarray
    hot_counts: np.ndarray

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.n + 0.1 * (self.v + 1))


def _filter(rows: list, shift: int, buckets: int) -> LogFrequencyFilter:
    sizes = np.zeros(buckets, np.int64)
    for b, x in rows:
        sizes[b] = len(x)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    bits = np.zeros(int(starts[-1]), np.uint8)
    for b, x in rows:
        bits[starts[b] : starts[b + 1]] = np.frombuffer(x, np.uint8)
    return LogFrequencyFilter(shift, starts, bits)


def _pair_parts(g: pa.Table) -> list:
    own = [_long(x) for x in g.column("keys").to_pylist()]
    return list(zip(own, _arrays(g, "a", "<u4"), [np.zeros(len(k), np.uint8) for k in own], _arrays(g, "b", "u1")))


def _weight(types: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """l of each level of contexts."""
    weight = np.where(uses > 0, uses / np.maximum(uses + types, 1), 0.0)
    weight[0] = 0.0  # contexts not seen say nothing
    return weight


def count_tokens(docs: DataFrame, shift: int) -> DataFrame:
    """(bucket, keys, train, total, filter, n_train, n_total, n_known): exact counts of all tokens, a row per bucket.
    docs: id, text, held."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held_back = [], 0
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                h, doc, _ = tokens(some.column("text").to_pylist())
                train = ~some.column("held").to_numpy(zero_copy_only=False)
                keys, inverse, total = np.unique(h, return_inverse=True, return_counts=True)
                parts.append((keys, np.bincount(inverse, weights=train[doc], minlength=len(keys)), total))
                parts.append((np.array([START], np.uint64), np.array([train.sum()]), np.array([0])))
                held_back += len(keys)
                if held_back > FLUSH:
                    merged = _merge(parts)
                    parts, held_back = [merged], len(merged[0])
                    if held_back > FLUSH // 2:
                        yield _packed(merged, shift, ("<u4", "<u4"))
                        parts, held_back = [], 0
        if parts:
            yield _packed(_merge(parts), shift, ("<u4", "<u4"))

    def reduce(bucket: int, parts) -> pa.RecordBatch:
        keys, train, total = _merge(parts)
        real = keys != START
        blob = lambda x, k: pa.array([x.astype(k).tobytes()], pa.binary())
        return pa.record_batch([
            pa.array([bucket], pa.int32()), blob(keys, "<u8"), blob(train, "<i8"), blob(total, "<i8"),
            *(pa.array([int(x)], pa.int64()) for x in (train[real].sum(), total[real].sum(), (train[real] > 0).sum(), level(train).sum())),
        ], names=["bucket", "keys", "train", "total", "n_train", "n_total", "n_known", "n_levels"])

    unpack = lambda g: list(zip(_arrays(g, "keys", "<u8"), _arrays(g, "a", "<u4"), _arrays(g, "b", "<u4")))
    fields = "bucket int, keys binary, train binary, total binary, n_train long, n_total long, n_known long, n_levels long"
    return _collected(docs.mapInArrow(count, _PACKED), fields, unpack, reduce)


def fit(docs: DataFrame, counts: DataFrame, shift: int, buckets: int, totals: tuple[int, int, int], hot: int) -> Model:
    """The model from training documents, all of it. docs: id, text, held; counts: of ``count_tokens``, staged."""
    spark = docs.sparkSession
    n_train, n_total, n_known = totals

    def unigram_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, hot_keys, hot_train = [], [], []
            for keys, train, total in zip(*(b.column(c).to_pylist() for c in ("keys", "train", "total"))):
                keys, train, total = np.frombuffer(keys, "<u8"), np.frombuffer(train, "<i8"), np.frombuffer(total, "<i8")
                made.append(LogFrequencyFilter.build(keys[train > 0], train[train > 0]))
                often = total * hot > n_total
                hot_keys.append(keys[often].tobytes())
                hot_train.append(train[often].tobytes())
            yield pa.record_batch([b.column("bucket"), *(pa.array(x, pa.binary()) for x in (made, hot_keys, hot_train))], names=["bucket", "filter", "keys", "train"])

    rows = counts.select("bucket", "keys", "train", "total").mapInArrow(unigram_filters, "bucket int, filter binary, keys binary, train binary").collect()
    unigrams = _filter([(r[0], r[1]) for r in rows], shift, buckets)
    keys = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(r[2], "<u8") for r in rows)])
    train = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(r[3], "<i8") for r in rows)])
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast(unigrams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held_back = [], 0
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                h, _, first = tokens(some.column("text").to_pylist())
                v = _before(h, first)
                pairs, where, n = np.unique(_pair(v, h), return_index=True, return_counts=True)
                contexts, back = np.unique(v[where], return_inverse=True)
                parts.append((pairs, n.astype(np.int32), np.zeros(len(n), np.uint8), shared.value.levels(contexts)[back].astype(np.uint8)))
                held_back += len(pairs)
                if held_back > FLUSH:
                    merged = _merge(parts)
                    parts, held_back = [merged], len(merged[0])
                    if held_back > FLUSH // 2:
                        yield _packed((merged[0], merged[1], merged[3]), shift, ("<u4", "u1"), short=True)
                        parts, held_back = [], 0
        if parts:
            merged = _merge(parts)
            yield _packed((merged[0], merged[1], merged[3]), shift, ("<u4", "u1"), short=True)

    def reduce(bucket: int, parts) -> pa.RecordBatch:
        keys, n, _, context = _merge(parts)
        types = np.bincount(context, minlength=LEVELS).astype("<i8")
        uses = np.bincount(context, weights=n, minlength=LEVELS).astype("<i8")
        made = LogFrequencyFilter.build(keys, n)
        return pa.record_batch([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (made, types.tobytes(), uses.tobytes()))], names=["bucket", "filter", "types", "uses"])

    counted = docs.where("not held").mapInArrow(count, _PACKED)
    rows = _collected(counted, "bucket int, filter binary, types binary, uses binary", _pair_parts, reduce).collect()
    shared.destroy()
    types = np.sum([np.frombuffer(r[2], "<i8") for r in rows] or [np.zeros(LEVELS)], axis=0)
    uses = np.sum([np.frombuffer(r[3], "<i8") for r in rows] or [np.zeros(LEVELS)], axis=0)
    return Model(unigrams, _filter([(r[0], r[1]) for r in rows], shift, buckets), _weight(types, uses), n_train, n_known, keys[order], train[order])


def _log10_of_levels(own: np.ndarray, context: np.ndarray, pair: np.ndarray, weight: np.ndarray, n: int, v: int) -> np.ndarray:
    """Of tokens by the levels of themselves, of the token before and of both together."""
    weight = weight[context]
    bigram = np.minimum(1.0, expected(pair) / np.maximum(expected(context), 1.0))
    return np.log10(weight * bigram + (1 - weight) * np.minimum(1.0, (expected(own) + 0.1) / (n + 0.1 * (v + 1))))


def log10_probabilities(model: Model, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each token after the one before it."""
    v = _before(h, first)
    words, back = np.unique(np.concatenate((h, v)), return_inverse=True)
    levels = model.unigrams.levels(words)
    return _log10_of_levels(levels[back[: len(h)]], levels[back[len(h) :]], model.bigrams.levels(_pair(v, h)), model.weight, model.n, model.v)


def _pack_texts(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _chunks(rows: DataFrame) -> DataFrame:
    """(chunk, x): about CHUNK bytes of text with id and held, packed; the last text of a chunk may be longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        made = lambda: pa.record_batch([pa.array([chunk], pa.int64()), pa.array([_pack_texts(held)], pa.binary())], names=["chunk", "x"])
        for b in batches:
            lo = 0
            for hi, n in enumerate(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist(), 1):
                size += n
                if size >= CHUNK:
                    held.append(b.slice(lo, hi - lo))
                    yield made()
                    chunk, held, size, lo = chunk + 1, [], 0, hi
            if lo < b.num_rows:
                held.append(b.slice(lo))
        if held:
            yield made()

    return rows.mapInArrow(run, "chunk long, x binary")


class Chunk:
    """Texts of a chunk as tokens; ``words`` and ``pairs``: its distinct ones, ascending, so by bucket."""

    def __init__(self, packed: bytes):
        t = pa.ipc.open_stream(packed).read_all()
        self.id, self.held = t.column("id").combine_chunks(), t.column("held").combine_chunks()
        self.train = ~self.held.to_numpy(zero_copy_only=False)
        self.h, self.doc, self.first = tokens(t.column("text").to_pylist())
        self.words = np.unique(np.append(self.h, START))

    def find_pairs(self) -> None:
        self.v = _before(self.h, self.first)
        self.pairs, self.where, self.pair = np.unique(_pair(self.v, self.h), return_index=True, return_inverse=True)


def _of_chunks(chunks: DataFrame, answers: DataFrame, work, fields: str) -> DataFrame:
    """Bring each chunk and its answers together. answers: (chunk, kind, bucket, a, b), kind 1 for words, 2 for pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 1):
            kind = g.column("kind").to_numpy()
            both = [(_arrays(g.filter(pa.array(kind == k)), "a", "u1"), g.filter(pa.array(kind == k))) for k in (1, 2)]
            levels = [np.concatenate(x) if x else np.zeros(0, np.uint8) for x, _ in both]
            train = np.concatenate(_arrays(both[0][1], "b", "<i8"))
            yield work(g.column("chunk")[0].as_py(), Chunk(g.column("x")[0].as_py()), levels[0], train, levels[1])

    no = F.lit(None).cast("binary")
    rows = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), "x", no.alias("a"), no.alias("b"))
    both = rows.unionByName(answers.select("chunk", "kind", "bucket", no.alias("x"), "a", "b"))
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(run, fields)


def _split(x: np.ndarray, lengths: list[int], kind: str) -> pa.Array:
    ends = np.cumsum([0, *lengths])
    return pa.array([x[lo:hi].astype(kind).tobytes() for lo, hi in zip(ends, ends[1:])], pa.binary())


_ANSWER = "chunk long, kind int, bucket int, a binary, b binary"


def word_answers(chunks: DataFrame, counts: DataFrame, shift: int) -> DataFrame:
    """Levels (a) and exact training counts (b) of the distinct words of each chunk, a row per chunk and bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, packed in zip(*(b.column(c).to_pylist() for c in ("chunk", "x"))):
                words = Chunk(packed).words
                sent = _packed((words, words, words), shift, ("u1", "u1"))
                yield pa.record_batch([pa.array(np.full(sent.num_rows, chunk)), sent.column("bucket"), sent.column("keys")], names=["chunk", "bucket", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 1):  # the bucket's counts come first, as chunk -1
            keys, *asked = _arrays(g, "keys", "<u8")
            train = np.frombuffer(g.column("train")[0].as_py(), "<i8")
            levels = LogFrequencyFilter.of_bucket(keys[train > 0], train[train > 0]).levels(keys)
            if asked:
                at, n = np.searchsorted(keys, np.concatenate(asked)), [len(x) for x in asked]
                yield pa.record_batch([
                    g.column("chunk").combine_chunks()[1:], pa.array(np.full(len(n), 1, np.int32)), g.column("bucket").combine_chunks()[1:],
                    _split(levels[at], n, "u1"), _split(train[at], n, "<i8"),
                ], names=["chunk", "kind", "bucket", "a", "b"])

    asked = chunks.mapInArrow(ask, "chunk long, bucket int, keys binary").withColumn("train", F.lit(None).cast("binary"))
    both = counts.select(F.lit(-1).cast("long").alias("chunk"), "bucket", "keys", "train").unionByName(asked)
    return both.select("bucket", "chunk", "keys", "train").repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, _ANSWER)


def pair_answers(chunks: DataFrame, words: DataFrame, shift: int) -> DataFrame:
    """Levels (a) of the distinct bigrams of each chunk, a row per chunk and bucket; and of each task a row of kind 3 with
    distinct followers (a) and counts (b) of the contexts of each level."""

    def ask(chunk: int, c: Chunk, levels: np.ndarray, train: np.ndarray, _) -> pa.RecordBatch:
        c.find_pairs()
        n = np.bincount(c.pair, weights=c.train[c.doc], minlength=len(c.pairs))
        sent = _packed((c.pairs, n, levels[np.searchsorted(c.words, c.v[c.where])]), shift, ("<u4", "u1"), short=True)
        return pa.record_batch([sent.column("bucket"), pa.array(np.full(sent.num_rows, chunk)), *sent.columns[1:]], names=["bucket", "chunk", "keys", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, uses = np.zeros(LEVELS, np.int64), np.zeros(LEVELS, np.int64)
        for g in _groups(batches, 1):
            parts = _pair_parts(g)
            keys, n, _, context = _merge(parts)
            seen = n > 0
            types += np.bincount(context[seen], minlength=LEVELS)
            uses += np.bincount(context, weights=n, minlength=LEVELS).astype(np.int64)
            levels = LogFrequencyFilter.of_bucket(keys[seen], n[seen]).levels(keys)
            lengths = [len(p[0]) for p in parts]
            yield pa.record_batch([
                g.column("chunk").combine_chunks(), pa.array(np.full(len(parts), 2, np.int32)), g.column("bucket").combine_chunks(),
                _split(levels[np.searchsorted(keys, np.concatenate([p[0] for p in parts]))], lengths, "u1"), pa.nulls(len(parts), pa.binary()),
            ], names=["chunk", "kind", "bucket", "a", "b"])
        yield pa.record_batch([pa.array([-1], pa.int64()), pa.array([3], pa.int32()), pa.array([-1], pa.int32()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (types, uses))], names=["chunk", "kind", "bucket", "a", "b"])

    asked = _of_chunks(chunks, words, ask, "bucket int, chunk long, keys binary, a binary, b binary")
    return asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, _ANSWER)


def score_in_chunks(rows: DataFrame, counts: DataFrame, shift: int, totals: tuple[int, int, int]) -> DataFrame:
    """As ``score``, without a broadcast: chunks ask the buckets of the filters. rows: id, text, held."""
    n, _, v = totals
    chunks = staged(_chunks(rows), "chunks")
    words = staged(word_answers(chunks, counts, shift), "word_levels")
    pairs = staged(pair_answers(chunks, words, shift), "pair_levels")
    sums = pairs.where("kind = 3").select("a", "b").collect()  # a row per task
    weight = _weight(*(np.sum([np.frombuffer(r[k], "<i8") for r in sums] or [np.zeros(LEVELS)], axis=0) for k in (0, 1)))

    def run(_, c: Chunk, levels: np.ndarray, train: np.ndarray, pair_levels: np.ndarray) -> pa.RecordBatch:
        c.find_pairs()
        own, docs = np.searchsorted(c.words, c.h), len(c.id)
        count = train[own]
        p = _log10_of_levels(levels[own].astype(np.int64), levels[np.searchsorted(c.words, c.v)].astype(np.int64), pair_levels[c.pair].astype(np.int64), weight, n, v)
        total = lambda x: np.bincount(c.doc, weights=x, minlength=docs)
        return pa.record_batch([
            c.id, c.held, *(pa.array(x, pa.int64()) for x in (np.diff(c.first), total(count > 0).astype(np.int64), np.full(docs, n))),
            pa.array(total(np.log10((count + 0.1) / (n + 0.1 * (v + 1))))), pa.array(total(p)),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _of_chunks(chunks, words.unionByName(pairs.where("kind = 2")), run, fields)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, hot: int = HOT,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _held_out(id_col).alias("held"))
    buckets = min(1 << 20, max(64, next_pow2(input_bytes(rows, "text") >> 20)))
    shift = 65 - buckets.bit_length()
    counts = staged(count_tokens(rows, shift), "token_counts")
    *totals, entries = (int(x) for x in counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "n_total", "n_known", "n_levels"))).first())
    if (entries + NEW_ENTRIES * totals[0]) * BITS > max_filter_bytes * 8:
        return score_in_chunks(rows, counts, shift, totals)
    model = fit(rows, counts, shift, buckets, totals, hot)
    shared = spark.sparkContext.broadcast(model)
    fields = "part int, place int, id long, held boolean, n_tokens long, n_known long, base double, score double, bucket int, keys binary, places binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        part, place = TaskContext.get().partitionId(), 0

        def table(n: int, **cols) -> pa.RecordBatch:
            kinds = dict(x.split() for x in fields.split(", "))
            arrow = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
            return pa.record_batch([cols[c] if c in cols and isinstance(cols[c], pa.Array) else pa.array(cols[c], arrow[k]) if c in cols else pa.nulls(n, arrow[k]) for c, k in kinds.items()], names=list(kinds))

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                n = some.num_rows
                h, doc, first = tokens(some.column("text").to_pylist())
                k = np.minimum(np.searchsorted(model.hot_keys, h), max(len(model.hot_keys) - 1, 0))
                known = model.hot_keys[k] == h if len(model.hot_keys) else np.zeros(len(h), bool)
                c = model.hot_counts[k[known]] if len(model.hot_keys) else np.zeros(0, np.int64)
                base = np.bincount(doc[known], weights=np.log10(model.unigram(c)), minlength=n)
                found = np.bincount(doc[known], weights=c > 0, minlength=n)
                total = np.bincount(doc, weights=log10_probabilities(model, h, first), minlength=n)
                yield table(n, part=np.full(n, part), place=np.arange(place, place + n), id=some.column("id"), held=some.column("held"), n_tokens=np.diff(first), n_known=found.astype(np.int64), base=base, score=total)
                rest = np.flatnonzero(~known)
                rest = rest[np.argsort(h[rest], kind="stable")]
                if len(rest):
                    sent = _packed((h[rest], doc[rest] + place, np.zeros(len(rest))), shift, ("<u4", "u1"))
                    m = sent.num_rows
                    yield table(m, part=np.full(m, part), bucket=sent.column("bucket"), keys=sent.column("keys"), places=sent.column("a"))
                place += n

    scored = staged(rows.mapInArrow(run, fields), "scored")
    own = scored.where("bucket is null").drop("bucket", "keys", "places")
    # occurrences of the other words meet their counts in the word's bucket
    sent = scored.where("bucket is not null").select("bucket", "part", "keys", F.col("places").alias("values"))
    both = counts.select("bucket", F.lit(-1).alias("part"), "keys", F.col("train").alias("values")).unionByName(sent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = shared.value.n, shared.value.v
        for g in _groups(batches, 1):
            parts = g.column("part").to_numpy()
            blobs = list(zip(g.column("keys").to_pylist(), g.column("values").to_pylist()))
            (table,) = np.flatnonzero(parts == -1)  # each word stands in the counts of its bucket
            keys, train = np.frombuffer(blobs[table][0], "<u8"), np.frombuffer(blobs[table][1], "<i8")
            for p in np.unique(parts[parts >= 0]).tolist():
                mine = [blobs[i] for i in np.flatnonzero(parts == p)]
                c = train[np.searchsorted(keys, np.concatenate([np.frombuffer(x, "<u8") for x, _ in mine]))]
                places, back = np.unique(np.concatenate([np.frombuffer(x, "<u4") for _, x in mine]), return_inverse=True)
                base = np.bincount(back, weights=np.log10((c + 0.1) / (n + 0.1 * (v + 1))))
                known = np.bincount(back, weights=c > 0)
                yield pa.record_batch([pa.array([p], pa.int32()), g.column("bucket").combine_chunks()[:1], *(pa.array([x], pa.binary()) for x in (places.astype("<u4").tobytes(), base.tobytes(), known.astype("<u4").tobytes()))], names=["part", "bucket", "places", "base", "known"])

    met = both.repartition("bucket").sortWithinPartitions("bucket", "part").mapInArrow(meet, "part int, bucket int, places binary, base binary, known binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 1):
            part = g.column("part")[0].as_py()
            at = np.concatenate(_arrays(g, "places", "<u4"))
            base, known = np.bincount(at, weights=np.concatenate(_arrays(g, "base", "<f8"))), np.bincount(at, weights=np.concatenate(_arrays(g, "known", "<u4")))
            some = np.unique(at)
            yield pa.record_batch([pa.array(np.full(len(some), part), pa.int32()), pa.array(some.astype(np.int32)), pa.array(base[some]), pa.array(known[some].astype(np.int64))], names=["part", "place", "more_base", "more_known"])

    more = met.repartition("part").sortWithinPartitions("part", "bucket").mapInArrow(add, "part int, place int, more_base double, more_known long")
    return own.join(more, ["part", "place"], "left").select(
        F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
