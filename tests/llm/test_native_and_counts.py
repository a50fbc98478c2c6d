"""op1 (URL verdicts), op7 (length histogram)."""

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from ledgerflow.llm import host_trust, length_histogram

from brute import SF_SMALL, public

PAGES = "page_id long, url string, html string, host string, n long"


def judged(spark, rows):
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], PAGES)
    return {r.page_id: r for r in host_trust.judge_urls(df).collect()}


def test_url_parts_and_longest_rule(spark):
    got = judged(spark, [
        (1, "HTTP://WWW.Example.NET/en/x?y#z", None), (2, "http://a.example.net/de/", ""), (3, "https://example.com/de/1", None), (4, "x://org/fr/", None),
        (5, "nothing here", None), (6, None, None), (7, "http://notexample.net", None), (8, "http://sub.org/fr", None), (9, "http://H?a/b://c", None),
    ])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 10)] == [
        ("www.example.net", "/en/x", "example.net/en/", "allow"), ("a.example.net", "/de/", "net/", "block"), ("example.com", "/de/1", "example.com/de/", "block"),
        ("org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notexample.net", "", None, "allow"), ("sub.org", "/fr", None, "allow"),
        ("h", "", None, "allow"),
    ]


def link(*hosts):
    return "".join(f'<p><A class="x" HREF=\'https://{h}/y\'>z</a>' for h in hosts)


def test_distrust_runs_against_links_and_trust_along_them(spark):
    got = judged(spark, [
        (1, "http://bad.net/x", None),  # blocked by rule: a seed of distrust
        (2, "http://farm.com/x", link("BAD.net", "bad.net")),  # links to nothing but the bad host
        (3, "http://far.com/x", link("farm.com")),  # two steps away, 0.85^2 > 0.5
        (4, "http://mixed.com/x", link("bad.net", "a.com", "b.com", "c.com", "d.com")),
        (5, "http://x.org/fr/1", link("loved.com")), (6, "http://loved.com/", link("bad.net")),
    ])
    # 4: a fifth of its links; 6: all of its links, 0.85, but trust reaches it with 0.85 as well
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_scores_match_a_plain_series(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 5), ("d", "a", 1)]
    seeds = [("a", 1.0, 0.0), ("c", 0.25, 0.5)]
    got = {r.host: r for r in host_trust.propagate(
        spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), 0.85, 30, 1e-12).collect()}
    for kind, flip in (("trust", False), ("distrust", True)):
        e = [(y, x, n) if flip else (x, y, n) for x, y, n in edges]
        total = {x: sum(n for u, _, n in edges if u == x) for x, _, _ in edges}  # of the linking host
        step = {h: (t if kind == "trust" else d) for h, t, d in seeds}
        score = dict(step)
        for _ in range(30):
            new = {}
            for x, y, n in e:
                new[y] = new.get(y, 0) + 0.85 * step.get(x, 0) * n / total[y if flip else x]
            step = new
            for h, v in new.items():
                score[h] = score.get(h, 0) + v
        for h, r in got.items():
            assert getattr(r, kind) == pytest.approx(score.get(h, 0), abs=1e-8)


def test_host_with_most_pages_blocked_is_blocked(spark):
    got = judged(spark, [(i, f"http://www.example.com/de/{i}", None) for i in range(3)] + [(9, "http://www.example.com/en/", None), (10, "http://b.example.com/de/", None), (11, "http://b.example.com/", None), (12, "http://b.example.com/x", None)])
    assert got[9].verdict == "block" and got[11].verdict == got[12].verdict == "allow"


def test_empty_pages(spark):
    assert judged(spark, []) == {}


@pytest.fixture(scope="module")
def lengths():
    t = Tokenizer.from_file(public("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_histogram_answers_for_every_limit(spark, lengths):
    table = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pydict()
    texts = [*table["text"], None, "", "", "x" * 3000, "a\tb  c\u00a0d\n\n e <|endoftext|>"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    hist = length_histogram.histogram(df).cache()
    n = sorted(map(lengths, texts))
    for r in hist.collect():
        assert (r.n_docs, r.n_tokens) == (n.count(r.length), n.count(r.length) * r.length)
        assert (r.docs_at_least, r.tokens_at_least) == (sum(x >= r.length for x in n), sum(x for x in n if x >= r.length))
        assert r.docs_at_most == sum(x <= r.length for x in n) and r.tokens_cut == sum(max(0, x - r.length) for x in n)
    for r in length_histogram.truncated_totals(hist, [0, 1, 100, 1000, 10**6]).collect():
        assert (r.n_docs, r.n_longer, r.n_tokens, r.n_kept_tokens) == (len(n), sum(x > r.context_limit for x in n), sum(n), sum(min(x, r.context_limit) for x in n))
    for r in length_histogram.length_quantiles(hist, [0.01, 0.5, 0.9, 1.0]).collect():
        assert sum(x <= r.length for x in n) >= r.share * len(n) > sum(x < r.length for x in n) - 1e-9


def test_empty_histogram(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    hist = length_histogram.histogram(df)
    assert hist.count() == 0 and length_histogram.truncated_totals(hist, [5]).count() == 0 and length_histogram.length_quantiles(hist, [0.5]).count() == 0


def test_verdicts_equal_their_sql(spark):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
    from oracle_check import compare, duck

    from ledgerflow.llm import queries

    df = queries.QUERIES["op1_host_trust"](spark, SF_SMALL)
    res = duck(SF_SMALL).execute(queries.ORACLE["op1_host_trust"])
    assert compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description]) is None
