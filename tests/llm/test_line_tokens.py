"""Line templates with a field per token against a plain version of the contract; short benchmark items; clashing columns."""

import random
import re
from collections import Counter, defaultdict

import brute
import pyarrow.parquet as pq
import pytest
from brute import SF_SMALL

import corpus_pipeline
from ledgerflow.llm import decontaminate, line_templates, near_join
from ledgerflow.llm.common import staged


def plain(docs, min_tokens=1, similarity=0.8):
    """Texts of [(doc_id, text)] without the lines of which enough tokens stand at their place in lines of the same leaf (number of
    tokens, first three) in documents before, and in enough documents in all."""
    where, lines = defaultdict(set), []
    for i, (doc_id, text) in enumerate(docs):
        for j, line in enumerate((text or "").split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in brute.words(line)]
            if len(w) >= min_tokens:
                keys = [(len(w), tuple(w[:3]), k, x) for k, x in enumerate(w)]
                lines.append((i, j, keys))
                for key in keys:
                    where[key].add(-(2**63) if doc_id is None else doc_id)
    least = {k: min(v) for k, v in where.items()}
    gone = defaultdict(set)
    for i, j, keys in lines:
        need, own = (2 if len(keys) >= 10 else 5), -(2**63) if docs[i][0] is None else docs[i][0]
        if sum(len(where[k]) >= need and least[k] < own for k in keys) >= similarity * len(keys) - 1e-9:
            gone[i].add(j)
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, (_, t) in enumerate(docs)]


def by_token(df, **how):
    return line_templates.drop_repeated_lines(df, fields=None, min_tokens=1, **how)


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))


def test_scattered_changes_and_short_lines(spark, docs):
    rng = random.Random(3)
    passage = [f"{rng.choice('abcdefgh')}word{chr(97 + rng.randrange(26))}{chr(97 + i % 26)}" for i in range(60)]
    rows = list(docs) + [(None, "Read more\nonly here"), (7, None), (8, ""), (9, "\n\n  \n")]
    for n in range(60):
        own = list(passage)
        for k in rng.sample(range(3, 60), n % 16):
            own[k] = f"own{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + k % 26)}"
        forty = passage[:40]
        for k in (5, 17, 33):
            forty[k] = f"name{chr(97 + n % 26)}{chr(97 + n // 26)}"
        rows.append((50_000 + n, f"Read more\n{' '.join(own)}\n{' '.join(forty)}\nMenu\npage {n}\n{n}\nfour words stand here{chr(97 + n % 26)}"))
    rows += rows[-3:]  # repeated rows
    rows.append((60_000, " ".join(passage * 2000)))
    rows.append((60_001, " ".join(passage * 2000)))  # a very long line
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _row int")
    got = by_token(df).select("doc_id", "text").collect()
    want = Counter((i, t) for (i, _), t in zip(rows, plain(rows)))
    assert Counter(tuple(r) for r in got) == want
    left = [t for i, t in want if i is not None and 50_000 <= i < 60_000]
    assert sum("Read more" in t for t in left) == 0 and sum("namea" in t for t in left) == 1
    # of the passages only the first one and those of the nine documents with more than 12 of 60 words changed stay
    assert sum(" ".join(passage[:3]) in t for t in left) == 1 + sum(n % 16 > 12 for n in range(60))
    # with one kind of line all documents are counted, with another threshold all follow the plain version too
    assert Counter((r.doc_id, r.text) for r in by_token(df, similarity=0.9).collect()) == Counter((i, t) for (i, _), t in zip(rows, plain(rows, similarity=0.9)))


def test_no_documents(spark):
    assert by_token(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_items_are_found_word_by_word(spark):
    rows = [(1, "See the Quick, fox jumps! And more."), (2, "the quick brown fox jumps"), (3, "jumps"), (4, None), (5, "The quick fox\njumps")]
    items = [(10, "the quick fox jumps"), (11, "jumps"), (12, "?!"), (13, "")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(df, bench, min_words=1).collect()
    assert sorted((r.doc_id, r.item_id, r.n_errors, r.n_item_words) for r in found) == [(1, 10, 0, 4), (1, 11, 0, 1), (2, 11, 0, 1), (3, 11, 0, 1), (5, 10, 0, 4), (5, 11, 0, 1)]
    assert decontaminate.find(df, bench).count() == 0 and decontaminate.drop_contaminated(df, bench).count() == 5
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench, min_words=4).collect()) == [2, 3, 4]


def test_clashing_columns_pass_the_pipeline(spark, docs):
    names = ["n_lines", "N_dropped", "_row", "_lines", "_gone", "quality", "pattern", "row", "cls", "keep", "n_words", "class_id"]
    long = "A line of ten words that stands in many documents here"
    rows = [(i, f"{t}\n{long}", "en", "a", 0, *[i * 100 + k for k in range(len(names))]) for i, t in docs[:60]]
    rows.append(rows[0][:1] + (rows[0][1].replace("A line", "a line"),) + rows[0][2:])
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names)
    df = spark.createDataFrame(rows, schema)
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = staged(stage(spark, df, SF_SMALL), f"clash_{name}")
        assert df.columns == columns, name
        assert all(tuple(r[5:]) == tuple(r[0] * 100 + k for k in range(len(names))) for r in df.collect()), name
    assert 0 < df.count() < len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF_SMALL).count() == df.count()
    near = spark.createDataFrame([(1, "a b c d e f", 5), (2, "A b c d e f", 6)], "doc_id long, text string, _gone long")
    assert [tuple(r) for r in near_join.drop_near_copies(near).collect()] == [(1, "a b c d e f", 5)]
