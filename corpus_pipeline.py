"""The corpus pipeline: from raw documents to the token ids of a training mix.

Five stages, each over all that the one before kept: the classifier drops what
it rejects; boilerplate lines go; of documents that share most of their
five-word shingles the one with the smallest doc_id stays; sources are mixed to
their target weights (a document may be taken several times, or not at all);
what was taken is encoded and decoded again.  All stages but the last return the columns of
``documents``; n_chars is that of the text as it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import bpe, jaccard_join, line_dedup, mixing, quality_cnn


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier does not reject."""
    return quality_cnn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that spread over many sources, but for their first document."""
    kept = line_dedup.dedup_lines(docs)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents as often as its target weight asks."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token ids and a digest of the decoded ids of each row of the mix."""
    return bpe.round_trips(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
#: A trained network and a tokenizer are beyond SQL; see tests/llm/test_models.py and test_pipeline_decoding.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
