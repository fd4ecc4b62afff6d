"""The pipeline: stages keep the columns, and each stage's decisions take effect."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from llm_cases import PROSE, docs_frame, empty_docs  # noqa: E402

from foreledger.llm import secrets  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_over_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL))
        assert docs.columns == columns
    rows = docs.collect()
    left = [r["text"] for r in rows]
    assert len(set(texts[r["doc_id"]] for r in rows)) == len(rows) > 0.7 * len(texts)
    assert not any(i in t for t in left for i in items)
    assert not any(secrets.secret_spans(t) for t in left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in rows}


def test_stages_take_hard_cases(spark):
    train = [(100 + k, PROSE * (1 + k % 3) + f"number {'abcdefgh'[k % 8] * 5}", "en") for k in range(60)]
    docs = docs_frame(spark).unionByName(docs_frame(spark, train))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL))
    ids = {r["doc_id"] for r in docs.collect()}
    assert not ids & {2, 3, 4, 9} and 1 in ids


def test_an_empty_table(spark):
    docs = empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL))
    assert docs.count() == 0
