"""Quality by weak supervision: rules vote good, bad or abstain; expectation-maximisation weighs them.

Each document is measured once in Arrow batches (numpy over the batch's bytes). Every rule turns its measure into a
vote. Documents with equal votes are alike to the model, so Spark counts vote patterns, at most 3^rules of them, and
expectation-maximisation runs over that table on the driver: it covers all documents and its size doesn't depend on
them. Each rule has two accuracies, the chance that a vote is ``good`` on a good document and ``bad`` on a bad one; the
prior is the share of good documents. The posterior probability of good decides, not a rule that all must pass.

Accuracies start from, and are smoothed towards, a weak belief (PRIOR_VOTES votes): votes of ``bad`` are rare on good
documents, and one rule sees only some kinds of bad documents. A rule whose ``bad`` would come to speak for a document
is held at no information, so the classes can't change places.

Edge cases: a null text counts as empty: no words, base_failed, not kept; words, lines and symbols are taken from whole
texts of any length; repeated rows are judged alike, each counted; an empty table gives no rows; other columns are
ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Words, mix64

RULES = ("length", "word_length", "symbols", "symbol_words", "line_repeats", "word_repeats", "capitals", "exclamations", "function_words", "line_ends")
GOOD, ABSTAIN, BAD = 1, 0, -1
# starting beliefs, and how many votes they weigh
PRIOR_GOOD, ON_GOOD, ON_BAD, PRIOR_VOTES = 0.8, 0.97, 0.3, 20.0
# frequent function words of English, French, German and Spanish
FUNCTION_WORDS = (
    "a an and are as at be by for from have in is it not of on or that the this to was with "
    "au avec dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "al como con del el es las los no para por se su y "
    "auf das dem den der die ein eine im ist mit nicht sich sie und von zu"
).split()
_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_WHITE = " \t\n\v\f\r"
_ENDS = tuple(".!?:;\"'»”)…")


def _function_hashes() -> np.ndarray:
    return np.sort(Words(FUNCTION_WORDS).hash)


def measure(texts: list[str | None], stop: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's counts and the rules' other measures for each text."""
    n = len(texts)
    w = Words(texts)
    low = Words(texts, lower=True)
    per_doc = lambda x: np.bincount(w.doc, weights=x, minlength=n).astype(np.int64)
    starts = np.concatenate(([0], w.byte_ends[:-1]))

    def chars(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[w.byte_ends] - total[starts]

    upper = (w.buf >= 65) & (w.buf <= 90)
    marks = np.concatenate(([0], np.cumsum(_SYMBOL[w.buf])))
    letter = upper | ((w.buf >= 97) & (w.buf <= 122))
    out = {
        "n_words": np.diff(w.first), "word_chars": per_doc(w.code_points()), "n_symbols": chars(_SYMBOL[w.buf]),
        "symbol_words": per_doc(marks[w.end] > marks[w.start]), "upper": chars(upper), "letters": chars(letter), "exclaims": chars(w.buf == 33),
    }
    at = np.minimum(np.searchsorted(stop, low.hash), len(stop) - 1)
    out["function_words"] = per_doc(stop[at] == low.hash)
    # three-word windows that stand twice or more in their text, and the words that such windows cover
    covered = np.zeros(len(w.hash), bool)
    if len(w.hash) >= 3:
        with np.errstate(over="ignore"):
            h = w.hash[:-2] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[2:]
            h = mix64(mix64(h) + w.doc[:-2].astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        own = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        order = own[np.argsort(h[own])]
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            covered[order[twice] + k] = True
    out["n_repeat_words"] = per_doc(covered)
    lines, dups, ended = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if t:
            own = [x for x in t.split("\n") if x.strip(_WHITE)]
            lines[i], dups[i] = len(own), len(own) - len(set(own))
            ended[i] = sum(x.rstrip(_WHITE).endswith(_ENDS) for x in own)
    return out | {"n_lines": lines, "n_dup_lines": dups, "ended": ended}


def vote(m: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of every rule (columns) on every text (rows)."""
    words, lines, letters = (np.maximum(m[k], 1).astype(float) for k in ("n_words", "n_lines", "letters"))

    def rule(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    long, symbols, caps = m["word_chars"] / words, m["n_symbols"] / words, m["upper"] / letters
    some = m["n_words"] >= 10
    votes = (
        rule(m["n_words"] >= 60, m["n_words"] < 50),
        rule((long >= 3) & (long <= 9), (long < 2) | (long > 14)),
        rule(symbols <= 0.02, symbols > 0.1),
        rule(m["symbol_words"] <= 0.03 * words, m["symbol_words"] > 0.15 * words),
        rule(m["n_dup_lines"] <= 0.2 * lines, m["n_dup_lines"] > 0.6 * lines),
        rule(m["n_repeat_words"] <= 0.1 * words, m["n_repeat_words"] > 0.3 * words),
        rule((caps <= 0.25) & (letters > 20), (caps > 0.5) & (letters > 20)),
        rule(m["exclaims"] <= 0.02 * words, m["exclaims"] > 0.3 * words),
        rule(m["function_words"] >= 0.08 * words, some & (m["function_words"] < 0.01 * words)),
        rule(m["ended"] >= 0.6 * lines, (m["ended"] < 0.1 * lines) & some),
    )
    return np.stack(votes, axis=1).astype(np.int8).reshape(-1, len(RULES))


def pattern_code(votes: np.ndarray) -> np.ndarray:
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(len(RULES))).sum(axis=1)


def pattern_votes(codes: np.ndarray) -> np.ndarray:
    return (np.asarray(codes, np.int64)[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1).astype(np.int8)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the contract's counts, pattern): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = _function_hashes()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                m = measure(some.column(1).to_pylist(), stop)
                cols = [some.column(0), *(pa.array(m[k], pa.int64()) for k in _FEATURES), pa.array(pattern_code(vote(m)), pa.int32())]
                yield pa.record_batch(cols, names=["doc_id", *_FEATURES, "pattern"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in _FEATURES) + ", pattern int")


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> dict[str, np.ndarray | float]:
    """Prior and accuracies by expectation-maximisation over vote patterns and how often each stands."""
    votes, n = pattern_votes(patterns), np.asarray(counts, float)
    good, bad = votes == GOOD, votes == BAD
    model = {"prior": PRIOR_GOOD, "on_good": np.full(len(RULES), ON_GOOD), "on_bad": np.full(len(RULES), ON_BAD)}
    for _ in range(rounds):
        p = posterior(model, votes)
        a, b = n * p, n * (1 - p)
        on_good = (a @ good + PRIOR_VOTES * ON_GOOD) / (a @ (good | bad) + PRIOR_VOTES)
        on_bad = (b @ bad + PRIOR_VOTES * ON_BAD) / (b @ (good | bad) + PRIOR_VOTES)
        on_good = np.clip(on_good, 0.01, 0.999)
        on_bad = np.clip(np.maximum(on_bad, 1 - on_good), 0.001, 0.999)  # bad must not speak for a document
        prior = float((a.sum() + PRIOR_VOTES * PRIOR_GOOD) / (n.sum() + PRIOR_VOTES))
        moved = max(abs(prior - model["prior"]), np.abs(on_good - model["on_good"]).max(), np.abs(on_bad - model["on_bad"]).max())
        model = {"prior": prior, "on_good": on_good, "on_bad": on_bad}
        if moved < tolerance:
            break
    return model


def posterior(model: dict, votes: np.ndarray) -> np.ndarray:
    """Probability that documents with these votes are good."""
    good, bad = votes == GOOD, votes == BAD
    score = np.log(model["prior"]) - np.log1p(-model["prior"])
    score = score + good @ (np.log(model["on_good"]) - np.log1p(-model["on_bad"])) + bad @ (np.log1p(-model["on_good"]) - np.log(model["on_bad"]))
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def fitted(features: DataFrame) -> dict:
    rows = features.groupBy("pattern").count().collect()  # at most 3^rules rows
    return fit(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept, quality): quality is the posterior probability of good."""
    features = measured(docs, id_col, text_col).checkpoint()
    model = fitted(features)
    spark = docs.sparkSession
    seen = [r[0] for r in features.select("pattern").distinct().collect()]
    quality = posterior(model, pattern_votes(np.array(seen, np.int64)))
    table = spark.createDataFrame([(int(c), float(q)) for c, q in zip(seen, quality)], "pattern int, quality double")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = features.join(F.broadcast(table), "pattern", "left")  # at most 3^rules rows
    return judged.select("doc_id", *_FEATURES, failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), F.round("quality", 6).alias("quality"))


def keep_good(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns."""
    model = fitted(measured(docs, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = _function_hashes()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                m = measure(some.column(at).to_pylist(), stop)
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                yield some.filter(pa.array(~failed & (posterior(model, vote(m)) >= threshold)))

    return docs.mapInArrow(run, docs.schema)
