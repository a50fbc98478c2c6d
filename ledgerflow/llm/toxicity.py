"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over all overlapping windows.

Inputs are the words of a text (runs of letters and digits, ASCII lower-cased). A word's vector is its entry in the table
of the training sample's words (one shared entry for all others) beside the mean of the hashed n-grams of its characters, so that
unseen inflections of a known stem are known. Two gated recurrent units read a window of WINDOW words in either
direction, attention weighs their states, and the weighed state gives the window's log odds. A document's score is that of
its most toxic window; windows start every STRIDE words and cover the whole text.

Training has labels of documents only. A window's share in its document's loss is the softmax of the windows' log odds,
flat at first and then sharper: the window that is thought to be toxic carries the label. The sample of labelled
rows is bounded by SAMPLE documents a class and SAMPLE_BYTES a text, taken by a hash of the id, and only that sample comes to the driver.
The trained model is broadcast; its size is fixed by the table's sizes, not by the data. Scoring reads every text whole.

Edge cases: a null or empty text, or one without letters, has one window without words and the score of no evidence; without
labelled rows of both classes every score is the share of toxic ones (0 if there are none); a document with several
label rows is toxic if any says so; null labels and ids aren't learnt from; rows with equal ids or texts are scored each;
a null id is not held out; very long texts are scored whole, a batch of windows at a time; an empty table gives no
rows; other columns are ignored, also those named as inputs here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Words, mix64

WINDOW, STRIDE = 32, 24  # words
STATE, ATTENTION = 8, 8
WORD_DIM, CHAR_DIM = 8, 16
VOCABULARY, LEAST_DOCS = 20_000, 3  # words of the table, and documents of the sample that a word must stand in
BUCKETS, GRAMS = 1 << 15, (3, 4, 5)
SAMPLE, SAMPLE_BYTES = 3000, 8000
EPOCHS, STEPS, RATE = 5, 300, 0.01  # at least so many passes, and steps in all
THRESHOLD = 0.3
WINDOWS_A_STEP = 1024
BATCH_BYTES = 4 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Distinct:
    """The distinct words of many texts, their n-gram buckets, and each text's windows over them.

    inverse: the distinct word of each word; first: each text's first word; grams, gram_at: buckets of all
    distinct words' n-grams and where each word's begin.
    """

    def __init__(self, texts: list[str | None]):
        words = Words(texts, lower=True, letters=True)
        self.hash, at, self.inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        self.first = words.first
        self.doc = words.doc
        start, size = words.start[at], words.end[at] - words.start[at]
        # every word with a mark on either side, one after another
        ends = np.cumsum(size + 2)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
        begin = ends - size - 2
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(begin + 1, size) + inner] = words.buf[np.repeat(start, size) + inner]
        flat[begin], flat[ends - 1] = 1, 2
        left = np.repeat(ends, size + 2) - np.arange(len(flat))  # bytes from each place to its word's end
        owner = np.repeat(np.arange(len(size)), size + 2)
        padded = np.append(flat, np.zeros(max(GRAMS), np.uint64))
        found, owners = [], []
        for n in GRAMS:
            code = np.full(len(flat), n, np.uint64)
            for k in range(n):
                code = code * np.uint64(257) + padded[k : k + len(flat)]
            ok = left >= n
            found.append((mix64(code[ok]) & np.uint64(BUCKETS - 1)).astype(np.int32))
            owners.append(owner[ok])
        own = np.concatenate(owners)
        order = np.argsort(own, kind="stable")
        self.grams = np.concatenate(found)[order]
        self.gram_at = np.searchsorted(own[order], np.arange(len(size) + 1))

    def windows(self, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """(text of each window, its words: WINDOW places of distinct words, the number of them past the end)."""
        n = np.diff(self.first)
        count = 1 + np.maximum(0, -(-(n - WINDOW) // stride))
        doc = np.repeat(np.arange(len(n)), count)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride
        at = (self.first[doc] + place)[:, None] + np.arange(WINDOW)
        inside = at < self.first[doc + 1][:, None]
        none = len(self.hash)
        padded = np.append(self.inverse, none)
        return doc, np.where(inside, padded[np.minimum(at, len(self.inverse))], none)


@dataclass
class Model:
    """Parameters. Vectors of words are ``words`` (its last row: any other word) beside the mean of ``grams``."""

    known: np.ndarray  # sorted hashes of the table's words
    p: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float = 0.0

    @classmethod
    def fresh(cls, known: np.ndarray, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        h, d = STATE, WORD_DIM + CHAR_DIM
        scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        p = {
            "words": rng.normal(0, 0.3, (len(known) + 1, WORD_DIM)).astype(np.float32), "grams": rng.normal(0, 0.6, (BUCKETS, CHAR_DIM)).astype(np.float32),
            "in": scale(2, d, 3 * h), "in_b": np.zeros((2, 3 * h), np.float32), "state": scale(2, h, 3 * h),
            "att": scale(2 * h, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": rng.normal(0, 0.5, ATTENTION).astype(np.float32),
            "out": rng.normal(0, 0.3, 2 * h).astype(np.float32), "out_b": np.full(1, -1.0, np.float32),
        }
        return cls(np.sort(known), p)

    def rows(self, x: Distinct) -> np.ndarray:
        """Place in the table of each distinct word."""
        if not len(self.known):
            return np.zeros(len(x.hash), np.int64)
        at = np.minimum(np.searchsorted(self.known, x.hash), len(self.known) - 1)
        return np.where(self.known[at] == x.hash, at, len(self.known))

    def vectors(self, x: Distinct) -> np.ndarray:
        sums = np.add.reduceat(self.p["grams"][x.grams], x.gram_at[:-1], axis=0) if len(x.hash) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate((self.p["words"][self.rows(x)], sums / np.diff(x.gram_at)[:, None].astype(np.float32)), axis=1)

    def forward(self, inputs: np.ndarray, idx: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Log odds of windows. inputs: per direction and distinct word (and one for none) the units' input terms."""
        n, h = len(idx), STATE
        there = idx < inputs.shape[1] - 1
        states, saved = np.empty((n, WINDOW, 2 * h), np.float32), ([], [])
        for way in (0, 1):
            s, u = np.zeros((n, h), np.float32), self.p["state"][way]
            for t in range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1):
                x, y = inputs[way][idx[:, t]], s @ u
                g = x[:, : 2 * h] + y[:, : 2 * h]
                np.negative(g, g), np.exp(g, g)
                g += 1
                np.reciprocal(g, g)
                z, r = g[:, :h], g[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
                new = c + z * (s - c)
                m = there[:, t, None]
                if keep:
                    saved[way].append((t, z, r, c, y[:, 2 * h :], s, m))
                s = np.where(m, new, s)
                states[:, t, h * way : h * way + h] = s
        a = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = np.where(there, a @ self.p["att_v"], -np.inf)
        top = np.where(there.any(1), e.max(1), 0)[:, None]
        w = np.exp(e - top)
        w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", w, states)
        return pooled @ self.p["out"] + self.p["out_b"][0], (states, saved, a, w, pooled)

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        x = np.matmul(vectors, self.p["in"]) + self.p["in_b"][:, None]
        return np.concatenate((x, np.zeros((2, 1, x.shape[2]), np.float32)), axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, the probability of its most toxic window."""
        if not self.p:
            return np.full(len(texts), self.prior)
        x = Distinct(texts)
        doc, idx = x.windows(STRIDE)
        inputs = self.inputs(self.vectors(x))
        odds = np.concatenate([self.forward(inputs, idx[lo : lo + WINDOWS_A_STEP])[0] for lo in range(0, len(idx), WINDOWS_A_STEP)])
        return _sigmoid(np.maximum.reduceat(odds.astype(np.float64), np.searchsorted(doc, np.arange(len(texts)))))

    def gradients(self, inputs: np.ndarray, idx: np.ndarray, saved: tuple, d_odds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the dense parameters, and of the input terms per direction and place of a window."""
        p, h = self.p, STATE
        states, steps, a, w, pooled = saved
        d_odds = d_odds.astype(np.float32)
        g = {"out": d_odds @ pooled, "out_b": d_odds.sum(keepdims=True), "state": np.zeros_like(p["state"])}
        d_pooled = d_odds[:, None] * p["out"]
        d_w = np.einsum("nth,nh->nt", states, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(1, keepdims=True))
        d_a = d_e[..., None] * p["att_v"] * (1 - a * a)
        g["att_v"] = np.einsum("nt,nta->a", d_e, a)
        g["att"] = np.einsum("nth,nta->ha", states, d_a, optimize=True)
        g["att_b"] = d_a.sum((0, 1))
        d_states = w[..., None] * d_pooled[:, None] + d_a @ p["att"].T
        d_in = np.zeros((2, *idx.shape, 3 * h), np.float32)
        for way in (0, 1):
            u, d_s = p["state"][way], np.zeros((len(idx), h), np.float32)
            for t, z, r, c, y_c, before, m in reversed(steps[way]):
                d = (d_s + d_states[:, t, h * way : h * way + h])
                d_new = d * m
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (before - c) * z * (1 - z)
                d_r = d_c * y_c * r * (1 - r)
                d_in[way, :, t, :] = np.concatenate((d_z, d_r, d_c), axis=1)
                d_y = np.concatenate((d_z, d_r, d_c * r), axis=1)
                g["state"][way] += before.T @ d_y
                d_s = d * ~m + d_new * z + d_y @ u.T
        return g, d_in


def _grouped_sums(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of the rows of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(rows[order], first, axis=0) if len(key) else rows


def train(texts: list[str | None], toxic: np.ndarray, prior: float, epochs: int = EPOCHS, least_steps: int = STEPS, seed: int = 7) -> Model:
    """Fit a model to texts and whether they are toxic; ``prior`` is the share of toxic rows of all that are labelled."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return Model(np.zeros(0, np.uint64), {}, float(prior))
    whole = Distinct(texts)
    stands = _grouped_sums(np.ones(len(whole.inverse), np.int64), whole.doc * len(whole.hash) + whole.inverse)[0] % max(len(whole.hash), 1)
    in_docs = np.bincount(stands, minlength=len(whole.hash))
    often = np.argsort(-in_docs, kind="stable")[:VOCABULARY]
    model = Model.fresh(whole.hash[often[in_docs[often] >= LEAST_DOCS]], seed)
    model.prior = float(prior)
    rows, p = model.rows(whole), model.p
    doc, idx = whole.windows(WINDOW)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    # classes weigh as they do among all labelled rows, but the rarer one a fifth of all at least
    share = max(prior, 0.2) if toxic.mean() > prior else toxic.mean()
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    square = {k: np.full(v.shape if k not in ("words", "grams") else (len(v), 1), 1e-6, np.float32) for k, v in p.items()}
    moment = {k: np.zeros_like(v) for k, v in p.items() if k not in ("words", "grams")}
    rng, steps = np.random.default_rng(seed), 0
    a_step = int(np.clip(len(texts) // 100, 8, 64))
    epochs = max(epochs, -(-least_steps * a_step // len(texts)))
    for epoch in range(epochs):
        sharp = (0.5, 2.0, 4.0)[min(5 * epoch // epochs, 2)]
        rate = RATE * (1 - 0.8 * epoch / max(1, epochs))
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), a_step):
            docs = order[lo : lo + a_step]
            own = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            used, local = np.unique(idx[at], return_inverse=True)
            local = local.reshape(len(at), WINDOW)
            if used[-1] == len(whole.hash):
                used = used[:-1]
            sizes = whole.gram_at[used + 1] - whole.gram_at[used]
            spread = np.repeat(whole.gram_at[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            grams, gram_word = whole.grams[spread], np.repeat(np.arange(len(used)), sizes)
            if not len(used):
                continue
            sums = np.add.reduceat(p["grams"][grams], np.cumsum(sizes) - sizes, axis=0)
            vectors = np.concatenate((p["words"][rows[used]], sums / sizes[:, None].astype(np.float32)), axis=1)
            inputs = model.inputs(vectors)
            odds, saved = model.forward(inputs, local, keep=True)
            # each window's share in its document
            top = np.full(len(docs), -np.inf)
            np.maximum.at(top, own, odds)
            e = np.exp(sharp * (odds - top[own]))
            share_w = e / np.bincount(own, e, minlength=len(docs))[own]
            doc_odds = np.bincount(own, share_w * odds, minlength=len(docs))
            d_doc = (_sigmoid(doc_odds) - toxic[docs]) * weight[docs] / len(docs)
            g, d_in = model.gradients(inputs, local, saved, share_w * d_doc[own])
            flat = local.reshape(-1)
            d_vec, g["in"], g["in_b"] = np.zeros_like(vectors), np.zeros_like(p["in"]), np.zeros_like(p["in_b"])
            order_w = np.argsort(flat, kind="stable")
            starts = np.searchsorted(flat[order_w], np.arange(len(used)))
            end = int(np.searchsorted(flat[order_w], len(used)))
            for way in (0, 1):
                d_words = np.add.reduceat(d_in[way].reshape(-1, 3 * STATE)[order_w[:end]], starts, axis=0)
                g["in"][way], g["in_b"][way] = vectors.T @ d_words, d_words.sum(0)
                d_vec += d_words @ p["in"][way].T
            steps += 1
            for k, m in moment.items():
                m += 0.1 * (g[k] - m)
                square[k] += 0.001 * (g[k] * g[k] - square[k])
                p[k] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.999**steps)) + 1e-7)
            d_gram = d_vec[:, WORD_DIM:] / sizes[:, None].astype(np.float32)
            for k, key, rows_d in (("words", rows[used], d_vec[:, :WORD_DIM]), ("grams", grams, d_gram[gram_word])):
                key, d = _grouped_sums(rows_d, key)
                square[k][key] += (d * d).mean(1, keepdims=True)
                p[k][key] -= 10 * rate * d / np.sqrt(square[k][key])
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, epochs: int = EPOCHS) -> Model:
    """Train on labelled documents that aren't held out: at most ``sample`` a class, of texts of ``sample_bytes`` at most."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max("toxic") == 1).alias("toxic"))
    seen = marks.groupBy("toxic").count().collect()  # two rows
    total = {r.toxic: r["count"] for r in seen}
    prior = total.get(True, 0) / max(1, sum(total.values()))
    rows = []
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text").between(1, sample_bytes))
    for kind in (True, False):
        order = [F.xxhash64("doc_id"), F.col("doc_id")]
        chosen = marks.where(F.col("toxic") == kind).orderBy(*order).limit(2 * sample).select("doc_id")  # some have longer texts
        rows += text.join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").limit(sample).select("text", F.lit(kind).alias("toxic")).collect()
    return train([r.text for r in rows], np.array([r.toxic for r in rows], bool), prior, epochs)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH_BYTES, "right")))
                some = batch.slice(lo, hi - lo)
                yield pa.record_batch([some.column(0), some.column(1), pa.array(shared.value.score(some.column(2).to_pylist()))], names=["doc_id", "held_out", "score"])
                lo = hi

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Learn from the labelled rows that aren't held out, score all rows."""
    return score(docs, fit(docs, labels, **how))
