"""Byte-level BPE: ranked merges folded over the bytes of distinct words by Spark's higher-order functions.

A rank file gives every token's bytes and rank, and the rank is the token's id. Its merges are recovered once on the
driver: each token of two bytes or more is what two parts become by merges of lower rank, and in a vocabulary that was
trained by merging only that pair ever becomes the token. The map from pairs of ids to merged ids is a literal of the
plan: an array of 64-bit slots, two places per pair, so a lookup is at most two array reads. A word's fold starts from
its bytes' ids and replaces the leftmost pair of lowest rank until no pair has a rank.

Words are the matches of the vocabulary's splitting pattern. The MEMO_WORDS most frequent words are folded once per
corpus by the higher-order functions and sent to the workers as a dictionary of that bound. All other words are merged
by the same ranks where they are met, in Python, with a bounded memory of the last ones: folding them in the plan as
well was measured at several times the CPU budget (figures in the README), and bringing each once to a place would
shuffle most of the corpus' words. So texts never move between machines, and what is shuffled are only counts of words,
added up before the shuffle.

Decoding concatenates the tokens' bytes by id.

Edge cases: a null or empty text has no ids and decodes to no bytes; repeated documents and ids are encoded each; an
empty table gives no rows; other columns are ignored. The pattern's letter, number and white space classes are Java's
(Unicode 13 in Java 17), so characters that later versions of Unicode added may split differently from a library with
newer tables.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import next_pow2

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# the public pattern of the rank files; (?U) makes Java's white space class that of Unicode
PATTERN = r"""(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_WORDS = 1 << 19
LONG_WORD = 512  # bytes; longer words aren't folded in the plan
SHORT_WORD = 200
OTHER_WORDS = 200_000  # that a task remembers
NONE = 2147483647  # the rank of a pair that doesn't merge
EDGE = 65535  # stands before the first and after the last id of a word; merges with nothing


def read_ranks(name_or_path: str) -> dict[bytes, int]:
    path = name_or_path
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(name_or_path)
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def recover_merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> merged id of every token of two bytes or more."""
    merges = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
            low = min(found)
            if low >= rank:
                break
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) != 2:
            raise ValueError(f"token {rank} isn't made by a merge of two tokens of lower rank")
        merges[ranks[parts[0]], ranks[parts[1]]] = rank
    return merges


def _hash(key: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)  # as the function xxhash64 of Spark has it


def slot_table(merges: dict[tuple[int, int], int]) -> list[int]:
    """Slots of pair << 16 | merged id, -1 if free; a pair stands in the place that either half of its hash names."""
    size = next_pow2(max(16, int(len(merges) * 2.2)))
    while True:
        slots: list[int] = [-1] * size
        for (left, right), rank in merges.items():
            entry = (left * 65536 + right) * 65536 + rank
            h = _hash(entry >> 16)
            at = h & (size - 1)
            for _ in range(500):
                entry, slots[at] = slots[at], entry
                if entry < 0:
                    break
                h = _hash(entry >> 16)
                one, two = h & (size - 1), (h >> 32) & (size - 1)
                at = two if at == one else one
            else:
                break
        else:
            return slots
        size *= 2


def _literal(values: list, kind: str) -> Column:
    """A value as one literal of the plan: Spark folds the parsed constant once."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass
class Vocabulary:
    """The literals that encoding and decoding need."""

    bytes_of: list[bytes]
    byte_ids: list[int]
    merges: dict[tuple[int, int], int]
    slots: list[int]

    @classmethod
    def load(cls, name_or_path: str = VOCABULARY) -> Vocabulary:
        ranks = read_ranks(name_or_path)
        if max(ranks.values()) >= EDGE or len(ranks) != len(set(ranks.values())):
            raise ValueError("ranks must be distinct and below 65535")
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        merges = recover_merges(ranks)
        return cls(by_id, [ranks[bytes([b])] for b in range(256)], merges, slot_table(merges))

    def encode_word(self, word: Column) -> Column:
        """array<int>: the ids of one word (a non-empty string)."""
        return self._with_tables(lambda slots, byte_ids: self._fold(word, slots, byte_ids))

    def _with_tables(self, use: Callable[[Column, Column], Column]) -> Column:
        """Each table is one literal of the plan, bound to a variable, however often an expression reads it."""
        return _let(_literal(self.slots, "array<bigint>"), lambda slots: _let(_literal(self.byte_ids, "array<int>"), lambda ids: use(slots, ids)))

    def _fold(self, word: Column, slots: Column, byte_ids: Column) -> Column:
        mask = F.lit(len(self.slots) - 1).cast("long")

        def merged(key: Column) -> Column:
            def probe(h: Column) -> Column:
                one, two = F.get(slots, h.bitwiseAND(mask).cast("int")), F.get(slots, F.shiftrightunsigned(h, 32).bitwiseAND(mask).cast("int"))
                rank = lambda entry: entry.bitwiseAND(F.lit(65535).cast("long")).cast("int")
                return F.when(F.shiftright(one, 16) == key, rank(one)).when(F.shiftright(two, 16) == key, rank(two)).otherwise(F.lit(NONE))

            return _let(F.xxhash64(key), probe)

        def pair(left: Column, right: Column) -> Column:
            return F.shiftleft(left.cast("long"), 16).bitwiseOR(right.cast("long"))

        def start(latin: Column) -> Column:
            own = F.transform(F.sequence(F.lit(1), F.length(latin)), lambda i: F.get(byte_ids, F.ascii(latin.substr(i, F.lit(1)))))
            edge = F.array(F.lit(EDGE))
            return _let(F.concat(edge, own, edge), lambda p: F.struct(p.alias("p"), F.transform(
                F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), pair), merged).alias("r")))

        def merge(s: Column, _: Column) -> Column:
            def at(low: Column) -> Column:
                def put(i: Column) -> Column:
                    around = F.transform(F.array(pair(F.get(s.p, i - 2), low), pair(low, F.get(s.p, i + 1))), merged)
                    return F.struct(
                        F.concat(F.slice(s.p, F.lit(1), i - 1), F.array(low), F.slice(s.p, i + 2, F.size(s.p))).alias("p"),
                        F.concat(F.slice(s.r, F.lit(1), i - 2), around, F.slice(s.r, i + 2, F.size(s.r))).alias("r"))

                return F.when(low == NONE, s).otherwise(_let(F.array_position(s.r, low).cast("int"), put))

            return _let(F.array_min(s.r), at)

        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # one character per byte
        return _let(latin, lambda t: F.aggregate(
            F.sequence(F.lit(1), F.length(t)), start(t), merge, lambda s: F.slice(s.p, F.lit(2), F.size(s.p) - 2)))

    def merge(self, word: str) -> list[int]:
        """The same ids for one word: a heap of (rank, place) over a linked list of parts."""
        ids = [self.byte_ids[b] for b in word.encode()]
        n, known = len(ids), self.merges
        if n < SHORT_WORD:  # few pairs: the least rank is found by looking at all
            ranks = [known.get(p, NONE) for p in zip(ids, ids[1:])]
            while ranks and (low := min(ranks)) != NONE:
                i = ranks.index(low)
                ids[i : i + 2] = [low]
                del ranks[i]
                if i:
                    ranks[i - 1] = known.get((ids[i - 1], low), NONE)
                if i < len(ranks):
                    ranks[i] = known.get((low, ids[i + 1]), NONE)
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(known[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in known]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (p := (ids[x], ids[after[x]])) in known:
                    heapq.heappush(heap, (known[p], x, *p))
        return [x for x, here in zip(ids, alive) if here]


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def frequent_words(docs: DataFrame, memo: int, text_col: str = "text") -> DataFrame:
    """The most frequent words, at most ``memo``: all of at least some count, by sixteenths of a power of two."""
    counts = docs.select(F.explode(split_words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.octet_length("word") <= LONG_WORD)
    counts = counts.withColumn("step", F.floor(F.log2("n") * 16).cast("int")).select("word", "step").checkpoint()
    total, least = 0, NONE
    for step, words in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 16 * 64 rows
        total += words
        if total > memo:
            break
        least = step
    return counts.where(F.col("step") >= least).select("word")


def _encoded(docs: DataFrame, vocabulary: Vocabulary, memo: int, id_col: str, text_col: str, use: Callable, schema: str) -> DataFrame:
    """``use`` turns document ids and their token ids (a list of arrays) into a batch of rows."""
    known = frequent_words(docs, memo, text_col).select("word", vocabulary.encode_word(F.col("word")).alias("ids")).toArrow()
    ids = known.column("ids").combine_chunks()
    values, ends = ids.values.to_numpy().astype("<u2"), ids.offsets.to_numpy() if len(ids) else np.zeros(1, np.int32)
    words = known.column("word").to_pylist()
    shared = docs.sparkSession.sparkContext.broadcast({w: values[ends[i] : ends[i + 1]].tobytes() for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: dict[str, bytes] = shared.value
        others: dict[str, bytes] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                out = []
                for words in some.column(1).to_pylist():
                    parts = list(map(frequent.get, words))
                    if None in parts:
                        for i, part in enumerate(parts):
                            if part is None:
                                part = others.get(words[i])
                                if part is None:
                                    if len(others) >= OTHER_WORDS:
                                        others.clear()
                                    part = others[words[i]] = np.array(vocabulary.merge(words[i]), "<u2").tobytes()
                                parts[i] = part
                    out.append(np.frombuffer(b"".join(parts), "<u2"))
                yield use(some.column(0), out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), split_words(F.col(text_col)).alias("words"))
    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, memo: int = MEMO_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): every document's token ids as array<int>."""

    def use(doc_id: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([doc_id, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _encoded(docs, Vocabulary.load(vocabulary), memo, id_col, text_col, use, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "ids") -> Column:
    """binary: the bytes of an array<int> of ids, as a native expression over ``encoded``."""
    pieces = _literal([p.hex() for p in Vocabulary.load(vocabulary).bytes_of], "array<string>")
    return F.unhex(F.array_join(F.transform(encoded[ids_col], lambda i: F.get(pieces, i)), ""))


def digests(docs: DataFrame, vocabulary: str = VOCABULARY, memo: int = MEMO_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of its decimal ids and of the bytes that the ids decode to."""
    loaded = Vocabulary.load(vocabulary)
    pieces, decimal = loaded.bytes_of, [str(i) for i in range(len(loaded.bytes_of))]

    def use(doc_id: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        lists = [x.tolist() for x in ids]
        return pa.record_batch([
            doc_id, pa.array([len(x) for x in lists], pa.int64()),
            pa.array([sha(",".join([decimal[i] for i in x]).encode()) for x in lists], pa.string()),
            pa.array([sha(b"".join([pieces[i] for i in x])) for x in lists], pa.string()),
        ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, loaded, memo, id_col, text_col, use, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
