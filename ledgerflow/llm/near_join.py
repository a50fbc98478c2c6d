"""N-gram Jaccard join: a MinHash LSH forest finds candidates, their whole shingle sets decide.

Texts are words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and their sets of five-word shingles (a shorter text is one
shingle of all its words). Two documents are linked where their sets' Jaccard similarity is at least ``threshold``.

1. Documents with equal words form a class; only one representative of each class goes on, whatever its size.
2. Every representative has a label of DEPTH minimum hashes in each of TREES prefix tries. Prefixes are shortened from
   the whole label until a pair at the threshold shares one with at least the target recall; that least depth follows
   from threshold, trees and target alone. Spark groups labels by that prefix. Within such a subtree a task holds the
   sorted labels and goes from the longest shared prefixes to shorter ones: clusters are joined where signatures agree
   nearly as well as the threshold asks, and a prefix all of whose documents are joined already costs nothing.
3. What hangs together by those joins is a component of candidates. All pairs within a component are verified on whole
   shingle sets, in blocks of BLOCK classes, each pair of blocks a task's group of its own; a block sends on only how
   many documents each class is linked to and a spanning forest of its links.
4. Connected components of the verified links give the class ids.

So no pair of rows is ever written for a group: a group of n different near copies costs n * n / BLOCK rows of text in
step 3 to count its links exactly. A subtree of more than SUBTREE representatives is split into parts of half as many, and
each pair of parts is a task's group of its own, so all its members meet. Components are found by joins; neither links nor labels come to the driver.

Edge cases: a null or empty text has no shingle and is linked to nothing; equal texts, however short, are linked;
repeated rows are copies of each other; a null id is smaller than none and never names a class unless its class has no
other; an empty table gives no rows; other columns are ignored by ``join`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Words, free_name, mix64, staged

THRESHOLD = 0.8
SHINGLE = 5
TREES, DEPTH = 20, 6
RECALL = 0.999  # of a pair at the threshold, by the tries
BLOCK = 1024
SUBTREE = 20_000
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def least_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that pairs at the threshold share in one of the trees with at least the target recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("too few trees for this recall")


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every shingle of each text, in text order; repeats within a text stay."""
    h, n = w.hash, len(w.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = h.copy()
        for k in range(1, size):
            inside = np.arange(n - k) if n > k else np.zeros(0, np.int64)
            same = w.doc[inside + k] == w.doc[inside]
            out[: len(inside)] = np.where(same, out[: len(inside)] * np.uint64(0x9E3779B97F4A7C15) + h[k:], out[: len(inside)])
    place = np.arange(n) - w.first[w.doc]
    count = np.diff(w.first)[w.doc]
    full = (place + size <= count) | ((place == 0) & (count < size))
    return mix64(out[full]), w.doc[full]


def signatures(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """uint32[n, TREES * DEPTH]: minimum hashes of each text's shingles; texts without any have the largest value."""
    out = np.full((n, TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    if len(h):
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        with np.errstate(over="ignore"):
            for k in range(TREES * DEPTH):
                out[doc[first], k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def _row(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def features(docs: DataFrame, depth: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, cls, keys, sig): class of equal words (null: no word), a key per tree for the prefix of ``depth``
    hashes, and one byte of every hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 250):
                some = b.slice(at, 250)
                w = Words(some.column(2).to_pylist(), lower=True)
                n = some.num_rows
                sig = signatures(*shingles(w), n)
                with np.errstate(over="ignore"):
                    place = np.arange(len(w.hash)) - w.first[w.doc] if len(w.hash) else np.zeros(0, np.int64)
                    weighed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(w.hash + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), dtype=np.uint64)))
                    cls = mix64(weighed[w.first[1:]] - weighed[w.first[:-1]] + np.diff(w.first).astype(np.uint64))
                    keys = np.repeat(np.arange(1, TREES + 1, dtype=np.uint64)[None, :], n, axis=0)
                    label = sig.reshape(n, TREES, DEPTH)
                    for d in range(depth):
                        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + label[:, :, d])
                none = np.diff(w.first) == 0
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * TREES)
                raw = np.ascontiguousarray(sig.astype(np.uint8))
                yield pa.record_batch([
                    some.column(0), some.column(1), pa.array(cls.view(np.int64), mask=none), pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1).view(np.int64))),
                    pa.array([r.tobytes() for r in raw], pa.binary()),
                ], names=["row", "doc_id", "cls", "keys", "sig"])

    rows = docs.select(_row(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, cls long, keys array<long>, sig binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal values in the first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def trie_joins(cls: np.ndarray, sig: np.ndarray, tree: int, depth: int, alike: int) -> list[tuple[int, int]]:
    """Pairs that join the members of one subtree: a spanning forest of what agrees in at least ``alike`` hashes."""
    n = len(cls)
    label = sig[:, tree * DEPTH : (tree + 1) * DEPTH]
    order = np.lexsort(label.T[::-1])
    cls, sig, label = cls[order], sig[order], label[order]
    cluster = np.arange(n)
    pairs = []
    for d in range(DEPTH, depth - 1, -1):
        change = np.flatnonzero((label[1:, :d] != label[:-1, :d]).any(axis=1)) + 1 if d > depth else np.zeros(0, np.int64)
        for lo, hi in zip(np.concatenate(([0], change)).tolist(), np.concatenate((change, [n])).tolist()):
            if hi - lo < 2 or (cluster[lo:hi] == cluster[lo]).all():
                continue
            own = cluster[lo:hi]
            for p in range(hi - lo):  # every member meets those after it that its cluster isn't joined with
                others = p + 1 + np.flatnonzero(own[p + 1 :] != own[p])
                if not len(others):
                    continue
                agree = (sig[lo + others] == sig[lo + p]).sum(axis=1) >= alike
                for q in others[agree].tolist():
                    if own[q] != own[p]:
                        pairs.append((int(cls[lo + p]), int(cls[lo + q])))
                        a, b = sorted((int(own[p]), int(own[q])))
                        cluster[cluster == b] = a
    return pairs


def candidate_links(classes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """(a, b): joins of classes found by the tries."""
    hashes = TREES * DEPTH
    alike = math.floor(hashes * threshold - 4 * math.sqrt(hashes * threshold * (1 - threshold)))
    labels = classes.select("cls", F.posexplode("keys").alias("tree", "key"))
    trees = labels.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.when(F.col("n") > SUBTREE, F.ceil(F.col("n") / (SUBTREE // 2))).otherwise(1).cast("int")
    dealt = labels.join(trees, "key").select("key", "tree", "cls", parts.alias("parts"), F.pmod(F.xxhash64("cls"), parts).cast("int").alias("part"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("part")))
    members = dealt.select("key", "tree", "cls", "part", F.explode(others).alias("other")).select(
        "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "tree", "cls").join(classes.select("cls", "sig"), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            if g.num_rows > 1:
                sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(-1, hashes)
                pairs = trie_joins(g.column("cls").to_numpy(), sig, g.column("tree")[0].as_py(), depth, alike)
                if pairs:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*pairs)], names=["a", "b"])

    ordered = members.select("key", "i", "j", "tree", "cls", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): connected components of undirected links (a, b); the root is the smallest node.

    Each round takes the smallest label among a node's neighbours, then the label's own label. Rounds end when no label
    changes; every round is written to the shared folder."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        up = step.select(F.col("node").alias("at"), F.col("new").alias("up"))
        new = step.join(up, step["new"] == up["at"], "left").select("node", "root", F.least("new", F.coalesce("up", "new")).alias("new")).checkpoint()
        changed = new.where("new != root").limit(1).count()
        labels = new.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def block_links(texts: list[str | None], block: np.ndarray, across: bool, threshold: float, columns: int = 4096) -> np.ndarray:
    """bool[n, n]: pairs that reach the threshold; only pairs from different blocks if ``across``."""
    n = len(texts)
    h, doc = shingles(Words(texts, lower=True))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    own = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    h, doc = h[own], doc[own]
    size = np.bincount(doc, minlength=n)
    _, col, often = np.unique(h, return_inverse=True, return_counts=True)
    common = often[col] > 1
    number = np.cumsum(often > 1) - 1
    col, doc = number[col[common]], doc[common]
    by_col = np.argsort(col, kind="stable")
    col, doc = col[by_col], doc[by_col]
    shared = np.zeros((n, n), np.float32)
    total = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, total, columns):
        a, b = np.searchsorted(col, (lo, lo + columns))
        m = np.zeros((n, min(columns, total - lo)), np.float32)
        m[doc[a:b], col[a:b] - lo] = 1
        shared += m @ m.T
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6
    linked &= shared > 0
    np.fill_diagonal(linked, False)
    if across:
        linked &= block[:, None] != block[None, :]
    return linked


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a graph given as a matrix."""
    seen, out = np.zeros(len(linked), bool), []
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            todo += new.tolist()
            out += [(x, y) for y in new.tolist()]
    return out


def verified(docs: DataFrame, members: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b, links): b null: class a is linked to ``links`` documents of a pair of blocks; else a link of the forest.
    members: row, cls, comp, blocks, size."""
    texts = docs.select(_row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    own = members.join(texts, "row").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    paired = own.select("comp", F.explode(each).alias("other"), "block", "cls", "size", "text").select(
        "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "size", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            cls = g.column("cls").to_numpy()
            _, first = np.unique(cls, return_index=True)  # rows that stand twice in the table count once here
            g, cls = g.take(pa.array(first)), cls[first]
            if len(cls) < 2:
                continue
            block, size = g.column("block").to_numpy(), g.column("size").to_numpy()
            linked = block_links(g.column("text").to_pylist(), block, g.column("i")[0].as_py() != g.column("j")[0].as_py(), threshold)
            links = (linked @ size).astype(np.int64) if len(size) else size
            some = np.flatnonzero(links)
            edges = _forest(linked)
            a = np.concatenate((cls[some], cls[[x for x, _ in edges]] if edges else cls[:0]))
            b = pa.array([None] * len(some) + [int(cls[y]) for _, y in edges], pa.int64())
            yield pa.record_batch([pa.array(a, pa.int64()), b, pa.array(np.concatenate((links[some], np.zeros(len(edges), np.int64))), pa.int64())], names=["a", "b", "links"])

    ordered = paired.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return ordered.mapInArrow(run, "a long, b long, links long")


def _joined(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``join`` with keep: the row of the class that stands first by id (null ids last) and row hash."""
    depth = least_depth(threshold, recall)
    own = staged(features(docs, depth, id_col, text_col), "shingled")
    classes = staged(
        own.where("cls is not null").groupBy("cls").agg(
            F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.min("row").alias("row"), F.count("*").alias("size"), F.first("keys").alias("keys"), F.first("sig").alias("sig")),
        "classes")
    found = components(candidate_links(classes, depth, threshold)).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    sizes = found.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = classes.select("cls", "row", "size").join(found, "cls").join(sizes, "comp")
    checked = staged(verified(docs, members, threshold, id_col, text_col), "verified")
    roots = components(checked.where("b is not null")).select(F.col("node").alias("cls"), "root")
    links = checked.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    per_class = classes.select("cls", "first_id", "first", "size").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = per_class.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min("first")["row"].alias("keep"))
    per_class = per_class.join(ids, "root").join(links, "cls", "left").select("cls", "class_id", "keep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return own.select("row", "doc_id", "cls").join(per_class, "cls", "left").select(
        "row", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "keep")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, class_id, n_links): one row per document; class_id is the smallest id of the documents it hangs
    together with by links, n_links the number of other documents that it is linked to itself."""
    return _joined(docs, threshold, recall, id_col, text_col).drop("keep")


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the first by id (null ids last) and then by a hash of id and text, with all its columns;
    rows equal in id and text count as one document and stay or go together."""
    gone = _joined(docs, threshold, recall, id_col, text_col).where("n_links > 0 and row != keep")
    name = free_name(docs, "_gone")
    return docs.join(gone.select(F.col("row").alias(name)).distinct(), _row(id_col, text_col) == F.col(name), "left_anti")
