"""The pipeline's last stage decodes what it encodes."""

from __future__ import annotations

import hashlib
import os

import corpus_pipeline
import pyarrow as pa
from paceline.llm import bpe

SF = "/root/testdata/sf0.001"


def test_last_stage_gives_back_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    docs = docs.cache()
    got = corpus_pipeline.encode(spark, docs, SF).collect()
    want = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in docs.collect())
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_odd_rows(spark, odd):
    assert sorted((r["doc_id"] or 0, r["decoded_sha256"]) for r in bpe.round_trips(odd).collect()) == sorted(
        (r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd.collect()
    )


def test_workers_hold_no_memo_between_tasks(spark, docs_of):
    docs = docs_of(["one two three", "four five\tsix  seven"]).coalesce(1)

    def held(batches):
        vocabulary = bpe.load(bpe.DEFAULT_FILE)
        for batch in batches:
            n = sum(len(m) + len(m.old) for m in (vocabulary.memo, vocabulary.chunks))
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows), pa.array([n] * batch.num_rows)], ["pid", "n"])

    # workers are used again, so among those of many tasks is the one that encoded
    assert bpe.round_trips(docs).count() == 2
    assert {r["n"] for r in spark.range(64).repartition(8).mapInArrow(held, "pid long, n long").collect()} == {0}
