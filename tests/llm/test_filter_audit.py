"""op13 (filter interaction audit)."""

import re
from itertools import permutations

import numpy as np
import pytest

from ledgerflow.llm import filter_audit as fa

from brute import words

DOCS = "doc_id long, text string, source string, label int, part string, failed int, digest string"


def plain(docs, labels):
    """(part, order, step) -> the audit's counts by applying each order to each document."""
    texts, marks, sets = {}, {}, []
    for i, q, t in labels:
        if i is not None:
            good, bad = marks.get(i, (False, False))
            marks[i] = good or q == 1, bad or t == 1
    for i, t, _ in docs:
        texts.setdefault(t or "", []).append(i)
    for i, t, part in docs:
        t = t or ""
        w = words(t)
        fails = {f for f, bad in {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i for j in texts[t])}.items() if bad}
        sets.append((part or "", fails, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out, shapley = {}, {}
    for part in {s[0] for s in sets}:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                row = dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0)
                for p, fails, good, bad in sets:
                    if p == part:
                        gone = bool(fails & set(order[: step - 1]))
                        removed = f in fails and not gone
                        row["kept"] += not gone and f not in fails
                        row["removed"] += removed
                        row["redundant"] += f in fails and gone
                        row["unique_fails"] += fails == {f}
                        row["good_lost"] += removed and good
                        row["toxic_lost"] += removed and bad
                out[part, order, step] = row
                shapley[part, f] = shapley.get((part, f), 0) + row["removed"]
    for (part, order, step), row in out.items():
        row["shapley"] = shapley[part, order[step - 1]]
    return out


def audited(spark, docs, labels, **how):
    d = spark.createDataFrame([(i, t, s, 9, "x", 31, "y") for i, t, s in docs], DOCS)
    ls = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    return {(r.part, r.filter_order, r.step): {k: v for k, v in r.asDict().items() if k not in ("part", "filter_order", "step")} for r in fa.audit(d, ls, **how).collect()}


LONG = " ".join(f"word{i}" for i in range(60))
CASES = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (2, LONG, "a"), (None, LONG, "a"), (4, None, None), (5, "", ""), (6, "AB " * 60, "b"), (7, "x# " * 60, "b"),
    (8, "one two", "c"), (8, "one three", "c"), (None, "nameless", None), (-3, "w\x0bv w\x1c w", "c"), (9, "ÄÖÜ é " * 40, "c"), (10, "many words here " * 40_000, "a"),
    *[(100 + i, "a copy", "hot") for i in range(200)], *[(400 + i, LONG + "!", "hot") for i in range(30)],
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (8, 1, 1), (None, 1, 1), (101, 1, 0), (150, 0, 1), (999, 1, 1), (402, 1, 1)]


@pytest.mark.parametrize("hot", [1, 1000])
def test_every_order_against_plain_filters(spark, hot):
    assert audited(spark, CASES, LABELS, hot=hot) == plain(CASES, LABELS)


def test_empty_tables(spark):
    assert audited(spark, [], LABELS) == {}
    assert audited(spark, CASES[:4], []) == plain(CASES[:4], [])


def test_popcounts_by_adders():
    rng = np.random.default_rng(3)
    words_, group = rng.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32), rng.choice(7, 5000, p=[0.6, 0.2, 0.1, 0.05, 0.03, 0.02, 0])
    got = fa.positional_popcounts(words_, group, 7)
    want = np.array([[np.count_nonzero(words_[group == g] >> np.uint32(b) & np.uint32(1)) for b in range(32)] for g in range(7)])
    assert (got == want).all()
    assert fa.positional_popcounts(words_[:0], group[:0], 2).sum() == 0


def test_a_survival_word_is_a_truth_table():
    table = fa.survival_words(np.arange(32))
    assert all(bool(int(table[f]) >> s & 1) == (not f & s) for f in range(32) for s in range(32))
