"""op12 (cross-tokenizer alignment)."""

import hashlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from ledgerflow.llm import encoder as en
from ledgerflow.llm import token_alignment as ta

from brute import SF_SMALL, public

TEXTS = [
    None, "", " ", "\n", "a", "a  b", " lead", "trail ", "tab\tand\x0bvt", "two\n\nlines", "one\ntwo three\nfour", "naïve 日本語 🎉🎉 don't I'LL", "<|endoftext|> <s> x</s> <0x0A> <unk>",
    "a▁b", "fine then ▁", " nbsp x y", "é ﬁ ½ ​", "nul\x00byte", "word " * 3000 + "end", "x" * 3000, "same text here", "same text here", "crlf\r\nline);\r\n", "日本" * 700,
]


@pytest.fixture(scope="module")
def sides():
    import json

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    path = public("byte_bpe_50k.json")
    a, b = Tokenizer.from_file(path), SentencePieceProcessor(model_file=public("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    entries = {i: e for e, i in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items()}
    alphabet = {e: bytes([i]) for i in range(256) for e in [en_entry(i)]}
    assert ByteLevel().decode([en_entry(65)]) == "A"
    entry_bytes = lambda i: b"".join(alphabet[c] for c in entries[i])

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
        x, y = [(i, entry_bytes(i)) for i in ids_a], [(i, piece(i)) for i in ids_b]
        whole = (" " + text).encode()
        return (x, y) if b"".join(p for _, p in x) == whole == b"".join(p for _, p in y) else ([], [])

    return tokens


def en_entry(byte):
    """The byte-level alphabet by its own rule: bytes without a visible Latin-1 form are counted from 256."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    return chr(byte) if byte in visible else chr(256 + sum(i not in visible for i in range(byte)))


def spans(tokens):
    out, at = [], 0
    for i, p in tokens:
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def plain(tokens, texts):
    docs = []
    for text in texts:
        x, y = map(spans, tokens(text) if text else ([], []))
        links, lo = [], 0
        for i, (_, s, e) in enumerate(x):
            while lo < len(y) and y[lo][2] <= s:
                lo += 1
            j = lo
            while j < len(y) and y[j][1] < e:
                links.append((i, j))
                j += 1
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, at = [], 0
        for cut in cuts:
            ids = [",".join(str(i) for i, s, e in side if at <= s and e <= cut) for side in (x, y)] if len(cuts) < 300 else None
            groups.append(ids)
            at = cut
        if len(cuts) >= 300:  # the same, in one pass
            bounds = [0, *cuts]
            own = [{}, {}]
            for k, side in enumerate((x, y)):
                g = 0
                for i, s, e in side:
                    while e > bounds[g + 1]:
                        g += 1
                    own[k].setdefault(g, []).append(str(i))
            groups = [(",".join(own[0][g]), ",".join(own[1][g])) for g in range(len(cuts))]
        text = ";".join("|".join(g) for g in groups)
        docs.append((x, y, links, len(cuts), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    count = Counter((x[i][0], y[j][0]) for x, y, links, *_ in docs for i, j in links)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for x, y, links, n_groups, sha in docs:
        own = [count[x[i][0], y[j][0]] for i, j in links]
        best = sum(n == highest[y[j][0]] for n, (_, j) in zip(own, links))
        out.append((len(x), len(y), n_groups, len(links), best, sum(own), sha))
    return out


def rows(df):
    return sorted((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


@pytest.mark.parametrize("words, pairs", [(1 << 18, 1 << 20), (0, 50), (40, 0)])
def test_report_against_plain_spans(spark, sides, words, pairs):
    table = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pydict()
    texts = [*table["text"], *TEXTS]
    df = spark.createDataFrame([(i, t, 1, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, row int, pair string, n long").repartition(3)
    got = rows(ta.report(df, frequent_words=words, hot_pairs=pairs))
    assert got == list(enumerate(plain(sides, texts)))


def test_repeated_and_null_ids_and_an_empty_table(spark, sides):
    texts = ["one two", "one two", "three", "a▁b"]
    df = spark.createDataFrame([(None, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3])], "doc_id long, text string")
    got = ta.report(df).collect()
    want = plain(sides, texts)
    assert sorted((r.doc_id or -1, r.n_a, r.count_sum) for r in got) == sorted([(-1, want[0][0], want[0][5]), (1, want[1][0], want[1][5]), (1, want[2][0], want[2][5]), (-1, 0, 0)])
    assert ta.report(df.limit(0)).collect() == []


def test_alignments_give_tokens_groups_and_links(spark, sides):
    texts = [t for t in TEXTS if t != "word " * 3000 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in ta.alignments(df, frequent_words=0).collect():
        t = texts[r.doc_id]
        x, y = map(spans, sides(t) if t else ([], []))
        assert (r.a_ids, r.b_ids) == ([i for i, *_ in x], [i for i, *_ in y])
        assert [(p.a, p.b) for p in r.links] == [(i, j) for i, (_, s, e) in enumerate(x) for j, (_, u, v) in enumerate(y) if s < v and u < e]
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        assert r.a_groups == [sum(c < e for c in cuts) for *_, e in x] and r.b_groups == [sum(c < e for c in cuts) for *_, e in y]


def test_word_memory_gives_the_libraries_ids(sides):
    a, b = en.WordMemoEncoder(public("byte_bpe_50k.json"), memo=50), en.PieceEncoder(public("piece_bpe_32k.model"), memo=50)
    texts = [t for t in TEXTS if t] + [f"w{i} x{i}\ny{i % 7} the" for i in range(200)]
    import numpy as np

    assert [np.frombuffer(x, "<u4").tolist() for x in a(texts)] == [a.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in a(texts, led=True)] == [a.tokenizer.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in b(texts)] == [b.model.encode(t) for t in texts]


def test_default_encoder_makes_of_special_strings_what_the_library_does():
    e = en.worker_encoder("byte_bpe_50k.json", plain_specials=False)
    texts = ["a <|endoftext|> b", "x<|endoftext|>y\n<|endoftext|>", "<|endoftext|>", "plain, text. don't stop.\nnew line, é. U.S. 3."]
    import numpy as np

    assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in np.frombuffer(e(texts)[0], "<u4")
