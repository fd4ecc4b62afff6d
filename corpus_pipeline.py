"""Corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foreledger.llm import decontaminate, langid, neardup, packing, secrets, simhash
from foreledger.sources.stored import stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; learns from the labelled ones."""
    return langid.accepted(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of every group linked by SimHash or by a five-word similarity of 0.8."""
    return neardup.deduplicated(docs, radius=simhash.RADIUS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def take_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the texts."""
    return secrets.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a training sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language id", keep_known_languages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret scans", take_out_secrets),
    ("packing", pack_sequences),
]

# Language models, 64-bit hashes and sequential packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
