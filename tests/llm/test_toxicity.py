"""op11 (toxicity)."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerflow.llm import toxicity as tx

SCHEMA = "doc_id long, text string, toxic int, score double, lang string"


def corpus(n, seed=1):
    """Texts of made-up words; a toxic one has one to three words of a root with changing ends, anywhere."""
    rng = random.Random(seed)
    piece = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words, bad = [piece() for _ in range(rng.randint(5, 150))], i % 4 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words) + 1), "zwork" + piece())
        out.append((" ".join(words) + ".", bad))
    return out


@pytest.fixture(scope="module")
def model():
    docs = corpus(600)
    return tx.train([t for t, _ in docs], np.array([b for _, b in docs]), 0.25)


def test_held_out_texts_are_told_apart(model):
    docs = corpus(300, seed=2)
    got = model.score([t for t, _ in docs]) >= tx.THRESHOLD
    want = np.array([b for _, b in docs])
    assert (got == want).mean() > 0.95 and (got & want).sum() > 0.9 * want.sum()


def plain_score(model, text):
    """The network word by word and window by window."""
    p, h = model.p, tx.STATE
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    vectors = []
    for w in words:
        x = tx.Distinct([w])
        grams = x.grams.tolist()
        assert len(grams) == sum(max(0, len(w.encode()) + 3 - n) for n in tx.GRAMS)
        known = np.flatnonzero(model.known == x.hash[0])
        own = p["words"][known[0] if len(known) else len(model.known)]
        vectors.append(np.concatenate((own, sum(p["grams"][g] for g in grams) / len(grams))).astype(float))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    best = -math.inf
    starts = [0]
    while starts[-1] + tx.WINDOW < len(words):
        starts.append(starts[-1] + tx.STRIDE)
    for start in starts:
        window = vectors[start : start + tx.WINDOW]
        both = []
        for way, order in ((0, window), (1, window[::-1])):
            s, states = np.zeros(h), []
            for v in order:
                x, y = v @ p["in"][way] + p["in_b"][way], s @ p["state"][way]
                z, r = sigmoid(x[:h] + y[:h]), sigmoid(x[h : 2 * h] + y[h : 2 * h])
                s = z * s + (1 - z) * np.tanh(x[2 * h :] + r * y[2 * h :])
                states.append(s)
            both.append(states if way == 0 else states[::-1])
        states = [np.concatenate(s) for s in zip(*both)]
        e = np.array([np.tanh(s @ p["att"] + p["att_b"]) @ p["att_v"] for s in states])
        w = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(e) else []
        pooled = sum((a * s for a, s in zip(w, states)), np.zeros(2 * h))
        best = max(best, pooled @ p["out"] + p["out_b"][0])
    return 1 / (1 + math.exp(-best))


TEXTS = [None, "", "  \n", "#$%", "One", "zworkba", "È É日本 don't\tx", "long " * 1000 + "zworkmi " + "text " * 900, "x" * 5000, *[t for t, _ in corpus(12, seed=5)]]


def test_scores_against_a_plain_network(model):
    assert model.score(TEXTS) == pytest.approx([plain_score(model, t) for t in TEXTS], abs=2e-4)


def test_every_part_of_a_long_text_counts(model):
    clean, _ = corpus(2, seed=9)[1]
    for place in (0, 0.31, 0.77, 1):
        words = (clean + " ").split() * 60
        words.insert(int(place * len(words)), "zworkdo")
        assert model.score([" ".join(words)])[0] > model.score([clean * 60])[0]


def test_gradients_against_differences():
    x = tx.Distinct(["one two three two", "four " * 40])
    model = tx.Model.fresh(np.sort(x.hash)[:2], seed=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, idx = x.windows(tx.STRIDE)
    inputs = model.inputs(model.vectors(x)).astype(np.float64)
    share = np.random.default_rng(1).normal(size=len(idx))
    value = lambda inp=inputs: float(share @ model.forward(inp, idx)[0])
    g, d_in = model.gradients(inputs, idx, model.forward(inputs, idx, keep=True)[1], share)
    rng, step = np.random.default_rng(2), 1e-3
    for k, d in g.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in model.p[k].shape)
            model.p[k][at] += step
            up = value()
            model.p[k][at] -= 2 * step
            assert (up - value()) / (2 * step) == pytest.approx(d[at], rel=0.03, abs=3e-3)
            model.p[k][at] += step
    for w in range(len(x.hash)):
        at = (1, w, 5)
        both = [value(inputs + step * sign * (np.indices(inputs.shape) == np.array(at)[:, None, None, None]).all(0)) for sign in (1, -1)]
        assert (both[0] - both[1]) / (2 * step) == pytest.approx(d_in[1][..., 5][idx == w].sum(), rel=0.03, abs=3e-3)


def rows(spark, docs):
    return spark.createDataFrame([(i, t, 1 - int(b), 0.5, "x") for i, (t, b) in docs], SCHEMA)


def test_judge_learns_only_from_rows_that_arent_held_out(spark):
    docs = list(enumerate(corpus(900)))
    docs += [(None, ("zworkfa here", True)), (7, (None, False)), (7, ("", False)), (-5, ("zworkfa", True))]
    labels = [(i, int(b)) for i, (t, b) in docs if i is not None and i >= 0] + [(0, 0), (None, 1), (3, None), (10**9, 1)]
    ls = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, toxic int, text string")
    df = rows(spark, docs)
    got = tx.judge(df, ls, epochs=6)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    truth = dict((i, b) for i, (_, b) in docs[:900])
    out = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 7]
    assert sum(r.predicted == truth[r.doc_id] for r in out) > 0.9 * len(out)
    # labels of held-out rows have no part in the model
    lied = [(i, 1 - b if i is not None and b is not None and zlib.crc32(str(i).encode()) % 4 == 2 else b) for i, b in labels]
    again = tx.judge(df, spark.createDataFrame(lied, "doc_id long, toxic int"), epochs=6).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, round(r.score, 5))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_one_class_only_and_empty_tables(spark):
    df = rows(spark, list(enumerate(corpus(8))))
    ls = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, toxic int")
    assert {r.score for r in tx.judge(df, ls).collect()} == {1.0}
    assert {(r.score, r.predicted) for r in tx.judge(df, ls.limit(0)).collect()} == {(0.0, 0)}
    assert tx.judge(df.limit(0), ls).collect() == []
