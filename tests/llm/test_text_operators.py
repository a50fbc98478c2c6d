"""op2 to op6 and op8 to op10 against plain versions, on the small tables and on awkward rows."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import SF_SMALL, public

from ledgerflow.llm import bloom_lm, byte_bpe, decontaminate, line_templates, near_join, tag_paths, token_frames, weak_quality
from ledgerflow.llm.common import Words

AWKWARD = [
    None, "", " ", "\n\n", "x", "x", "the\tthe the", "a b c d e f g a b c d e f g", "é" * 700, "z" * 2000 + " end", "   lead and  double\r\n\ttabs 　",
    "naïve 日本語 🎉🎉 <|endoftext|> don't I'LL", "one two three four five six seven eight nine ten\n" * 30, "# $ % & | < >", "word " * 5000,
]


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"]))
    return rows + [(10_000 + i, x) for i, x in enumerate(AWKWARD)] + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def frame(spark, docs):
    """The rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, 7, "x", [1], "k", 0.5) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, cls string, keys array<int>, row string, score double").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_words_are_the_pattern_s(docs):
    texts = [t for _, t in docs]
    for lower in (False, True):
        w = Words(texts, lower=lower)
        assert np.diff(w.first).tolist() == [len(brute.words(t)) for t in texts]
        by_hash = {}
        for h, x in zip(w.hash.tolist(), (x for t in texts for x in brute.words(t, lower))):
            assert by_hash.setdefault(h, x) == x
        assert len(by_hash) == len({x for t in texts for x in brute.words(t, lower)})
        assert Words(texts[::-1], lower=lower).hash.tolist()[-int(w.first[1]) :] == w.hash.tolist()[: int(w.first[1])]


# op2


def test_scores(frame, docs):
    got = {}
    for r in bloom_lm.score(frame).collect():
        got.setdefault(r.doc_id, []).append(r)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    counts = Counter(w for i, t in docs if not held[i] for w in [*brute.words(t, True), "<end>"])
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        w = [*brute.words(t, True), "<end>"]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in counts for x in w), n)
            assert r.base_score == pytest.approx(base) and r.score < 0
    rows = [r for x in got.values() for r in x]
    assert len(rows) == len(docs)
    for h in (True, False):
        assert sum(r.score for r in rows if r.held_out == h) > sum(r.base_score for r in rows if r.held_out == h)


def test_words_beyond_the_broadcast_ones_count_the_same(frame):
    key = lambda r: (r.doc_id, r.n_known, round(r.base_score, 6))
    assert sorted(map(key, bloom_lm.score(frame, hot=4).collect())) == sorted(map(key, bloom_lm.score(frame).collect()))


def test_filter_reads_levels_and_keeps_its_limit():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64), np.minimum(rng.zipf(1.5, 20_000), 1 << 30)
    bits = bloom_lm.LogFrequencyFilter.build(keys, counts, 1 << 20)
    f = bloom_lm.LogFrequencyFilter(64 - 1, np.array([0, len(bits), len(bits)]), np.frombuffer(bits, np.uint8))
    f.shift = 63
    low = keys < np.uint64(1 << 63)
    true = bloom_lm.level(counts)[low]
    assert (f.levels(keys[low]) >= true).all() and (f.levels(keys[low]) == true).mean() > 0.95
    other = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert (f.levels(other) > 0).mean() < 0.05
    assert len(bloom_lm.LogFrequencyFilter.build(keys, counts, 5000)) <= 5000
    assert bloom_lm.level(np.array([0, 1, 2, 3, 4, 1023, 1024])).tolist() == [0, 1, 2, 2, 3, 10, 11]


def test_filters_beyond_the_limit_score_the_same(frame, spark, empty, monkeypatch):
    def rows(df, **options):
        got = bloom_lm.score(df, **options)
        key = lambda r: tuple(-1 if x is None else x for x in r)
        return got.columns, sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()), key=key)

    odd = spark.createDataFrame([(None, "a b a"), (None, None), (7, "a b a"), (7, "a b a"), (8, ""), (3, "c a b")], "doc_id long, text string")
    for chunk in (8 << 20, 5_000):
        monkeypatch.setattr(bloom_lm, "CHUNK", chunk, raising=False)
        for df in (frame, odd, odd.where("text is null"), odd.where("false")):
            (columns, want), (own, got) = rows(df, hot=64), rows(df, max_filter_bytes=0)
            assert columns == own and [r[:5] for r in got] == [r[:5] for r in want]
            assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]])
    assert bloom_lm.score(empty, max_filter_bytes=0).count() == 0


def test_no_documents_no_scores(empty):
    assert bloom_lm.score(empty).count() == 0


# op3


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN.removeprefix("(?U)"), mergeable_ranks=byte_bpe.read_ranks(byte_bpe.VOCABULARY), special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_bpe_is_the_library_s(frame, docs, bpe):
    got = {r.doc_id: r for r in byte_bpe.digests(frame, memo=1000).collect()}
    for i, t in docs:
        ids, r = bpe.encode_ordinary(t or ""), got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())), t


def test_decode_turns_ids_into_bytes(spark, docs, bpe):
    some = spark.createDataFrame([(i, t) for i, t in docs[-20:]], "doc_id long, text string")
    encoded = byte_bpe.encode(some)
    texts = dict(docs)
    for r in encoded.select("doc_id", "ids", byte_bpe.decode(encoded).alias("back")).collect():
        assert list(r.ids) == bpe.encode_ordinary(texts[r.doc_id] or "") and bytes(r.back) == (texts[r.doc_id] or "").encode()


def test_words_merged_outside_the_plan(bpe):
    v, rng = byte_bpe.Vocabulary.load(), random.Random(3)
    for _ in range(200):
        w = "".join(rng.choice("abthein 日é") for _ in range(rng.randrange(1, 400)))
        assert v.merge(w) == bpe._core_bpe.encode_single_piece(w.encode())


def test_bpe_of_nothing(empty):
    assert byte_bpe.digests(empty).count() == 0


# op4


def test_quality_counts_and_base(frame, docs):
    texts = {}
    for i, t in docs:
        texts.setdefault(i, t)
    rows = weak_quality.judge(frame).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, *rest = brute.quality_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest]
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n) and not (r.base_failed and r.kept)


def test_quality_agrees_with_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in weak_quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in rows) >= 0.97 * len(rows)


def test_accuracies_are_recovered():
    rng = np.random.default_rng(5)
    good = rng.random(60_000) < 0.7
    rules = len(weak_quality.RULES)
    on_good, on_bad = np.linspace(0.85, 0.97, rules), np.linspace(0.5, 0.9, rules)
    says_bad = np.where(good[:, None], rng.random((len(good), rules)) > on_good, rng.random((len(good), rules)) < on_bad)
    votes = np.where(rng.random(says_bad.shape) < 0.2, 0, np.where(says_bad, -1, 1)).astype(np.int8)
    codes, counts = np.unique(weak_quality.pattern_code(votes), return_counts=True)
    model = weak_quality.fit(codes, counts)
    assert np.abs(model["on_good"] - on_good).max() < 0.03 and np.abs(model["on_bad"] - on_bad).max() < 0.03 and abs(model["prior"] - 0.7) < 0.02
    assert ((weak_quality.posterior(model, votes) >= 0.5) == good).mean() > 0.97


def test_kept_documents_keep_their_columns(frame):
    kept = weak_quality.keep_good(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in weak_quality.judge(frame).where("kept").collect())


def test_quality_of_nothing(empty):
    assert weak_quality.judge(empty).count() == 0 and weak_quality.keep_good(empty).count() == 0


# op5


def variants(seed, n, length=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(length)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check_near(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int")
    got = near_join.join(df).select("doc_id", "class_id", "n_links").collect()
    want = [(i, c, n) for (i, _), (c, n) in zip(rows, brute.near(rows))]
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_near_join_on_documents_and_variants(spark, docs):
    more = [t for s in range(12) for t in variants(s, 6)] + ["Short one", "short ONE", "short one more"]
    check_near(spark, docs + [(20_000 + i, t) for i, t in enumerate(more)])


def test_large_group_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 8)
    monkeypatch.setattr(near_join, "SUBTREE", 16)
    check_near(spark, [(i, t) for i, t in enumerate(variants(1, 60) + variants(2, 3) + ["same text"] * 40)])


def test_members_of_different_parts_of_a_subtree_meet(spark, monkeypatch):
    monkeypatch.setattr(near_join, "SUBTREE", 4)
    rng = np.random.default_rng(9)
    rows = []
    for k in range(20):  # pairs that agree in all hashes, pairs of a family that shares one prefix only
        sig = rng.integers(0, 256, near_join.TREES * near_join.DEPTH, dtype=np.uint8)
        sig[: near_join.DEPTH] = 1
        rows += [(2 * k, [5], bytearray(sig.tobytes())), (2 * k + 1, [5], bytearray(sig.tobytes()))]
    found = near_join.candidate_links(spark.createDataFrame(rows, "cls long, keys array<long>, sig binary"), 5, 0.8).collect()
    assert {tuple(sorted(r)) for r in found} == {(2 * k, 2 * k + 1) for k in range(20)}


def test_clusters_are_joined_by_any_of_their_members():
    rng = np.random.default_rng(3)
    a0, b0 = rng.integers(0, 256, (2, near_join.TREES * near_join.DEPTH), dtype=np.uint8)
    a0[: near_join.DEPTH], b0[: near_join.DEPTH] = 1, 1
    a1, b1 = a0.copy(), b0.copy()
    a1[6:36], b1[36:66] = 7, 8
    b1[:36], b1[66:] = a1[:36], np.where(np.arange(54) < 12, a1[66:], b0[66:])  # a1 and b1 share some hashes of b0's
    sig = np.stack([a0, a1, b0, b1])
    agree = (sig[:, None] == sig[None]).sum(axis=2)
    alike = int(min(agree[0, 1], agree[2, 3]))
    first = [agree[0, 2], agree[0, 3], agree[1, 2]]
    alike = min(alike, int(agree[1, 3]))
    assert alike > max(first)
    assert len(near_join.trie_joins(np.arange(4), sig, 0, 5, alike)) == 3


def test_null_ids_and_one_document_of_each_group(spark):
    rows = [(None, "a b c d e f g h"), (5, "a b c d e f g h"), (7, "A B c d e f g h"), (8, ""), (9, ""), (None, None), (None, "only here x y"), (None, "only here x y"), (4, "other words")]
    check_near(spark, rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    kept = near_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in [rows[1], *rows[3:9]])


def test_one_text_of_groups_with_equal_or_null_ids(spark):
    groups = [[(5, "a b c d e f g"), (5, "A b c d e f g"), (5, "a B c d e f g")], [(None, "p q r s"), (None, "P q r s")], [(None, "k l m"), (None, "K l m"), (9, "k L m")]]
    kept = [tuple(r) for r in near_join.drop_near_copies(spark.createDataFrame(sum(groups, []), "doc_id long, text string")).collect()]
    assert [sum(x in g for x in kept) for g in groups] == [1, 1, 1] and (9, "k L m") in kept


def test_least_depth():
    assert near_join.least_depth(0.8, 0.999, 20, 6) == 5 and near_join.least_depth(0.8, 0.9999999, 20, 6) < 5
    with pytest.raises(ValueError):
        near_join.least_depth(0.01, 0.999)


def test_near_join_of_nothing(empty):
    assert near_join.join(empty).count() == 0 and near_join.drop_near_copies(empty).count() == 0


# op6


def test_token_files_round_trip(spark, frame, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want, start = [], 0
    for i, text in sorted(docs, key=lambda x: (x[0], x[1] or "")):
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_frames.round_trip(frame, file_bytes=50_000).collect()) == sorted(want)


def test_special_strings_as_the_library_reads_them(spark, tmp_path):
    from tokenizers import Tokenizer

    from ledgerflow.llm.queries import QUERIES

    t = Tokenizer.from_file(public("byte_bpe_50k.json"))
    text = "a <|endoftext|> b"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for plain, got in ((False, QUERIES["op6_token_frames"](spark, str(tmp_path))), (True, token_frames.round_trip(spark.read.parquet(f"{tmp_path}/documents.parquet")))):
        t.encode_special_tokens = plain
        ids = np.asarray([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert [tuple(r) for r in got.collect()] == [(1, 0, len(ids), zlib.crc32(ids.tobytes()))]


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_frames_are_independent_checked_and_standard():
    import zstandard

    out = Source()
    contents = [(3, b"abcd" * 100), (None, b""), (3, b"wxyz"), (-7, bytes(range(256)) * 4)]
    assert token_frames.write_frames(out, contents) == (4, sum(len(c) for _, c in contents))
    f = token_frames.FrameFile(out)
    assert f.ids == [3, None, 3, -7] and [f.content(k) for k in (3, 0, 2, 1)] == [contents[k][1] for k in (3, 0, 2, 1)]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain == b"".join(c for _, c in contents)  # a reader that knows no seek table skips it
    raw = bytearray(out.getvalue())
    raw[-9 - 12 * 5 + 8] ^= 1  # the first frame's checksum
    with pytest.raises(token_frames.Corrupt):
        token_frames.FrameFile(Source(bytes(raw))).content(0)
    nothing = Source()
    token_frames.write_frames(nothing, [])
    assert len(token_frames.FrameFile(nothing)) == 0


def test_no_documents_no_tokens(empty):
    assert token_frames.round_trip(empty).count() == 0


# op8

PAGES = {
    "<html><body><nav><a>x</a></nav><div class='ad'>Buy. Now.</div><article><h1>T &amp;c</h1><p>a  b\n<b>c</b><br>d<p>e</article><footer>&copy;</footer></body></html>": "T &c\na b c d\ne",
    "<article><p>one<ul><li>x<li>y</ul><table><tr><td>1<td>2</table><aside>no</aside><div id='comments'><p>No, never.</p></div></article>": "one\nx\ny\n1\n2",
    "<body><div id='sidebar'><p>Long text. It goes on, and on.</p></div><div><p>Main text, which is long enough, and has marks.</p><p>More of it.</p></div>": "Main text, which is long enough, and has marks.\nMore of it.",
    "<p title='a>b'>x<!-- <p>no --> y</p><script>var t='</p>';</script><style>p{}</style>z<p cla": "x y\nz",
    "<article><form><p>Name?</p></form><p>kept</p><div style='display: none'>gone</div></article>": "kept",
    "plain text &lt;b&gt;": "plain text <b>", "": "", "<p></p><br>": "", "<": "<", "<nav>menu</nav>": "", "<article>": "",
}


def test_pages(spark):
    rows = [(i, f"u{i}", h, 1) for i, h in enumerate([*PAGES, None])]
    got = {r.page_id: r for r in tag_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    for i, want in enumerate([*PAGES.values(), ""]):
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), f"u{i}")


def test_articles_of_the_pages_table(spark):
    import html

    table = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in tag_paths.extract(table).collect()}
    for r in table.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", s)).split()) for s in re.split(r"</?(?:h1|p)[^>]*>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_very_long_page():
    page = "<div>" * 3000 + "<p>text, long enough.</p>" * 3000
    assert tag_paths.main_text(page).count("\n") == 2999


MAIN = "".join(f"<p>Paragraph {i} of the main text, which is long enough to count, and has marks of its own, too.</p>" for i in range(6))
MAIN_TEXT = "\n".join(re.findall("<p>(.*?)</p>", MAIN))


def test_ratios_decide_beside_an_article():
    teaser = "<article><a href='x'>More news</a></article>"
    links = "<ul>" + "".join(f"<li><a href='{i}'>Topic {i}</a></li>" for i in range(4)) + "</ul>"
    assert tag_paths.main_text(f"<body><div>{MAIN}</div><ul><li>Home<li>About<li>Shop</ul></body>") == MAIN_TEXT
    assert tag_paths.main_text(f"<body><div>{MAIN}</div>{teaser}</body>") == MAIN_TEXT  # the text outside a teaser
    assert tag_paths.main_text(f"<body>{teaser}<div>{MAIN}</div>{teaser}</body>") == MAIN_TEXT
    assert tag_paths.main_text(f"<article><h1><a href='/'>A title</a></h1>{links}{MAIN}</article>") == f"A title\n{MAIN_TEXT}"


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-comments", "page-search", "content-ad-free", "search", "widget"])
def test_a_wrapper_s_name_is_evidence_only(name):
    side = "<div class='sidebar-left'><p>Long text, which goes on, and on. It has marks, too.</p></div>"
    for kind in ("class", "id"):
        assert tag_paths.main_text(f"<body><div {kind}='{name}'><article><h1>Title</h1>{MAIN}</article></div></body>") == f"Title\n{MAIN_TEXT}"
        assert tag_paths.main_text(f"<body><div {kind}='{name}'>{MAIN}</div></body>") == MAIN_TEXT
    assert tag_paths.main_text(f"<body><div class='{name}'><article>{MAIN}</article>{side}</div></body>") == MAIN_TEXT


@pytest.mark.parametrize("name", ["ad", "ad-top", "site-footer", "comments", "comment_list", "sidebar2", "related-posts"])
def test_boilerplate_names_still_count(name):
    part = f"<div class='x {name}'><p>Something long, which isn't the main text. It has marks, too.</p></div>"
    for page in (f"<body><article>{MAIN}{part}</article></body>", f"<body><div>{MAIN}</div>{part}</body>", f"<body>{part}<article>{MAIN}</article></body>"):
        assert tag_paths.main_text(page) == MAIN_TEXT


# op9


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(500):
        p, t = ([rng.randrange(4) for _ in range(rng.randrange(1, m))] for m in (90, 120))
        assert decontaminate.myers(np.array(p, np.uint64), np.array(t, np.uint64))[0] == brute.substring_distance(p, t)


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[i] = "Changed"
        elif kind == 1:
            w.insert(i, "added")
        elif len(w) > 1:
            del w[i]
    return w


def test_items_within_the_budget_are_found(spark, docs):
    t = pq.read_table(f"{SF_SMALL}/benchmark.parquet").to_pydict()
    items = [*zip(t["item_id"], t["text"]), (900, None), (901, ""), (902, "the"), (903, t["text"][0])]
    rng = random.Random(4)
    rows = list(docs)
    for n, (_, item) in enumerate(items[:40]):
        w = edited(rng, item.split(), rng.randrange(0, 9))
        rows.append((30_000 + n, f"{docs[n % 50][1]} ... {' '.join(w).upper()}!! {docs[n % 70][1]}"))
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((rows[i][0], item, d) for (i, item), d in brute.contaminated(rows, items).items())
    assert Counter((r.doc_id, r.item_id, r.n_errors) for r in decontaminate.find(df, bench).collect()) == want
    blocks = decontaminate.find(df, bench, block_bytes=2000)
    assert Counter((r.doc_id, r.item_id, r.n_errors) for r in blocks.collect()) == want
    gone = {i for i, _, _ in want}
    kept = decontaminate.drop_contaminated(df, bench, block_bytes=2000)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in gone)


def test_nothing_to_find(spark, empty, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(empty, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert decontaminate.find(frame, none).count() == 0 and decontaminate.drop_contaminated(frame, none).count() == frame.count()


# op10


def test_line_templates(spark, docs):
    rng = random.Random(6)
    long = [f"t{rng.randrange(10**5)}" .replace("1", "a") for _ in range(60)]
    rows = list(docs)
    for n in range(8):
        own = list(long)
        own[20 + n] = f"changed{n}x"  # a variable field in a passage of 60 words
        rows.append((40_000 + n, f"Line of its own {n} and more of it\n{' '.join(own)}\nDate: 2024-01-{n + 10:02d} printed by host{n}\n{docs[n][1]}"))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_lines int, extra int")
    got = line_templates.drop_repeated_lines(df).collect()
    want = Counter((i, t) for (i, _), t in zip(rows, brute.line_dedup(rows)))
    assert Counter((r.doc_id, r.text) for r in got) == want
    left = sum(" ".join(long[:18]) in (r.text or "") for r in got)
    assert left == 1  # the passage stays in its first document only


def test_lines_of_nothing(empty):
    assert line_templates.drop_repeated_lines(empty).count() == 0
