"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared as words: runs of letters, digits and other non-ASCII characters, A-Z lower-cased, so
case, punctuation and line ends make no difference. An item of m words may be found with at most
``k = floor(error_rate * m)`` words inserted, deleted or replaced. It is split into k + 1 pieces; whatever the k edits
are, one piece stands in the document unchanged (the pigeonhole principle), so every match is among the places where a
piece is found. Pieces are found by the hash of their first words in one pass over the batch's rolling hashes, and each
place is verified with Myers' bit-parallel edit distance over the words that an alignment with k edits can reach.

The items travel to the tasks in blocks of at most ``block_bytes`` of text, one pass over the documents each; a
benchmark of usual size is one block. Documents never move.

An item of up to six words has no budget and must stand in a text word by word. Items of fewer than ``min_words`` words
aren't searched for: the query op9 asks for all (1) and reports each match with its item's words (``n_item_words``), while
``drop_contaminated``, and so the pipeline, leaves out items under MIN_WORDS unless the caller says otherwise, as a word or two
would match, and remove, clean documents everywhere.

Edge cases: a null or empty text matches nothing; a null or empty item, or one without a letter or digit, is never found;
of matches with equal distance the first in the text is reported; texts and items of any length are compared whole; repeated items and documents match each for itself; an
empty table on either side gives no matches; other columns are ignored by ``find`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Words

ERROR_RATE = 0.15
MIN_WORDS = 5
BLOCK_BYTES = 32 << 20
_FILTER_BITS = 22
_STEP = np.uint64(0x9E3779B97F4A7C15)


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the whole pattern to any stretch of the text, and the place after that stretch's end."""
    m = len(pattern)
    if not m:
        return 0, 0
    places: dict[int, int] = defaultdict(int)
    for i, x in enumerate(pattern.tolist()):
        places[x] |= 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = ones, 0, m, m, 0
    for j, x in enumerate(text.tolist(), 1):
        eq = places.get(x, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus  # where the diagonal doesn't grow
        up, down = minus | (ones & ~(zero | plus)), plus & zero
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & ones, (down << 1) & ones  # a match may begin anywhere
        plus, minus = down | (ones & ~(zero | up)), up & zero
        if score < best:
            best, end = score, j
    return best, end


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    out = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = out * _STEP + h[k : len(h) - n + 1 + k]
    return out


class Items:
    """Benchmark items of one block, with the pieces to look for."""

    def __init__(self, rows: list[tuple], error_rate: float, min_words: int):
        words = Words([t for _, t in rows], lower=True, letters=True)
        self.ids, self.words, self.budget = [], [], []
        pieces = defaultdict(lambda: defaultdict(list))  # anchor length -> hash -> [(item, offset)]
        for i, (item_id, _) in enumerate(rows):
            own = words.hash[words.first[i] : words.first[i + 1]]
            if len(own) < max(1, min_words):
                continue
            k = int(error_rate * len(own))
            at = len(self.ids)
            self.ids.append(item_id)
            self.words.append(own)
            self.budget.append(k)
            cuts = [round(j * len(own) / (k + 1)) for j in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                n = min(hi - lo, 4)
                pieces[n][int(_rolling(own[lo : lo + n], n)[0])].append((at, lo, hi))
        self.pieces = []
        for n, by_hash in sorted(pieces.items()):
            keys = np.array(sorted(by_hash), np.uint64)
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.pieces.append((n, keys, bits, [by_hash[int(x)] for x in keys]))

    def matches(self, texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) -> (edit distance, index of the word after the match), the best of each."""
        w = Words(texts, lower=True, letters=True)
        places: set[tuple[int, int, int]] = set()  # text, item, where the item would begin
        for n, keys, bits, found in self.pieces:
            if len(w.hash) < n:
                continue
            h = _rolling(w.hash, n)
            at = np.flatnonzero(bits[h >> np.uint64(64 - _FILTER_BITS)])
            at = at[w.doc[at] == w.doc[at + n - 1]]
            k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            hit = keys[k] == h[at]
            for p, q in zip(at[hit].tolist(), k[hit].tolist()):
                doc = int(w.doc[p])
                for item, lo, hi in found[q]:
                    whole = p + hi - lo <= w.first[doc + 1] and np.array_equal(w.hash[p : p + hi - lo], self.words[item][lo:hi])
                    if whole:
                        places.add((doc, item, p - lo))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, item, begin in sorted(places):
            k, own = self.budget[item], self.words[item]
            if best.get((doc, item), (k + 1, 0))[0] == 0:
                continue
            lo, hi = max(begin - k, int(w.first[doc])), min(begin + len(own) + k, int(w.first[doc + 1]))
            distance, end = myers(own, w.hash[lo:hi])
            if distance <= k and distance < best.get((doc, item), (k + 1, 0))[0]:
                best[doc, item] = (distance, lo + end - int(w.first[doc]))
        return best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, error_rate: float, min_words: int, block_bytes: int) -> Iterator[Items]:
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // block_bytes)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield Items([(r[0], r[1]) for r in part.collect()], error_rate, min_words)


def find(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_errors, n_item_words, end_word): the best match of each item found in each document."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_errors int, n_item_words int, end_word long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in _blocks(benchmark, item_id_col, item_text_col, error_rate, min_words, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    some = b.slice(at, 1000)
                    ids = some.column(0).to_pylist()
                    got = [(ids[d], items.ids[i], e, len(items.words[i]), end) for (d, i), (e, end) in items.matches(some.column(1).to_pylist()).items()]
                    cols = list(zip(*got)) or [()] * 5
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "n_errors", "n_item_words", "end_word"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES,
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_id_col, item_text_col, error_rate, min_words, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    some = b.slice(lo, 1000)
                    clean = np.ones(some.num_rows, bool)
                    clean[[d for d, _ in shared.value.matches(some.column(at).to_pylist())]] = False
                    yield some.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
