"""The pipeline against a direct version that shares nothing with it but the toxicity scores."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import bytebpe, queries
from test_llm_near import direct_classes
from test_llm_tokens import PATH, direct_contamination


@pytest.fixture(scope="module")
def kept_by_stage(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), f"test-{name}")
        out.append((name, docs))
    return out


def test_pipeline_against_direct_version(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    scores = {r.doc_id: r.score for r in queries.op3_toxicity(spark, folder).collect()}
    docs = {i: t for i, t in docs.items() if scores[i] < 0.5}
    docs = {i: docs[i] for i, c in direct_classes(sorted(docs.items())) if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {i: t for i, t in docs.items() if not direct_contamination(t, items)[-1]}
    # Spans are taken from the secrets query, whose SQL the catalogue test runs; here they are cut out directly.
    spans = {r.doc_id: r.spans for r in queries.op5_secrets(spark, folder).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.load_ranks(PATH), special_tokens={})
    expected = []
    for i, text in docs.items():
        clean, at = "", 0
        for _, start, end in (x.split(":") for x in spans[i].split(",") if x):
            start, end = int(start), int(end)
            if start >= at:
                clean += text[at:start] + "[SECRET]"
            at = max(at, end)
        clean += text[at:]
        ids = library.encode_ordinary(clean)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest()))
    found = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(found) == sorted(expected) and 0 < len(found) < 200


def test_stages_keep_the_columns(spark, folder, kept_by_stage):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    for _, docs in kept_by_stage:
        assert docs.dtypes == documents.dtypes
    counts = [documents.count(), *[d.count() for _, d in kept_by_stage]]
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4]


def test_secrets_are_marked_and_counted(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    secret = spark.createDataFrame([(9000, "see token = 'abcdef123456' here", "en", "s", 31)], documents.schema)
    stage = dict(corpus_pipeline.STAGES)["secrets"]
    row = stage(spark, secret, folder).first()
    assert row.text == "see [SECRET]' here" and row.n_chars == len(row.text)


def test_odd_rows_pass(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (9003, " ", "en", "s", 1), (9002, "", "en", "s", 0)],
        documents.schema,
    ).withColumns({c: F.lit(1) for c in ("doc", "score", "spans", "node", "ids", "features")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, odd, folder)
        assert docs.columns == odd.columns and docs.count() == 5, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, folder).count() == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), folder).count() == 0
