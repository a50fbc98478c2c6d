"""The corpus pipeline against plain versions of its stages, each over what the one before kept."""

import hashlib

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import SF_SMALL

import corpus_pipeline
from ledgerflow.llm import byte_bpe, weak_quality
from ledgerflow.llm.common import staged


@pytest.fixture(scope="module")
def plain():
    """Documents left by each stage, as [(doc_id, text)], and the last stage's rows."""
    import tiktoken

    t = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pydict()
    b = pq.read_table(f"{SF_SMALL}/benchmark.parquet").to_pydict()
    docs = list(zip(t["doc_id"], t["text"]))
    m = weak_quality.measure([x for _, x in docs], weak_quality._function_hashes())
    votes = weak_quality.vote(m)
    model = weak_quality.fit(*np.unique(weak_quality.pattern_code(votes), return_counts=True))
    good = weak_quality.posterior(model, votes) >= 0.5
    counts = [brute.quality_counts(x) for _, x in docs]
    kept = [d for d, g, c in zip(docs, good, counts) if g and c[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    lines = [(i, x) for (i, _), x in zip(kept, brute.line_dedup(kept))]
    near = [d for d, (cls, n) in zip(lines, brute.near(lines)) if n == 0 or cls == d[0]]
    leaks = {i for i, _ in brute.contaminated(near, list(zip(b["item_id"], b["text"])))}
    clean = [d for i, d in enumerate(near) if i not in leaks]
    enc = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN.removeprefix("(?U)"), mergeable_ranks=byte_bpe.read_ranks(byte_bpe.VOCABULARY), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = []
    for i, x in clean:
        ids = enc.encode_ordinary(x)
        rows.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(x.encode())))
    return [kept, lines, near, clean], rows


def test_each_stage(spark, plain):
    stages, rows = plain
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages):
        docs = staged(stage(spark, docs, SF_SMALL), f"test_{name}")
        assert docs.columns == columns
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
        assert docs.where("n_chars != length(text)").count() == 0
    assert 0 < len(rows) < len(stages[0])
    assert sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()) == sorted(rows)


def test_run(spark, plain):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_SMALL).collect()) == sorted(plain[1])


def test_awkward_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "x y", "en", "a", 3), (2, "x y", "en", "a", 3)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = staged(stage(spark, docs, SF_SMALL), f"awkward_{name}")
        assert docs.count() == len(rows)
        assert corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, schema), SF_SMALL).count() == 0
