"""Queries of the corpus operators, each over its whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreledger.llm import sql
from foreledger.sources.stored import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, posterior quality and verdict of every document."""
    from foreledger.llm import quality

    return quality.judged(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their place in a training sequence."""
    from foreledger.llm import packing

    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from foreledger.llm import langid

    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    from foreledger.llm import tokens

    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that consists of control strings; read them back."""
    from foreledger.llm import chat

    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_conversations(rows))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from foreledger.llm import simhash

    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains to 0.8 or more of its shingles."""
    from foreledger.llm import decontaminate

    found = decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment").distinct()


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    from foreledger.llm import secrets

    return secrets.span_digests(secrets.scan(_table(spark, sf_dir, "documents")))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record per page to a content-addressed archive and read the archive back."""
    from foreledger.llm import warc

    path = scratch_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with keyed surrogates for the personal data in it."""
    from foreledger.llm import pii

    return pii.pseudonymised(_table(spark, sf_dir, "documents"), secret="corpus-surrogates-v1")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and draw of every document, resampled towards the benchmark."""
    from foreledger.llm import importance

    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op12_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    from foreledger.llm import itq

    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transform every document, restore every output, and digest both."""
    from foreledger.llm import fim

    both = fim.restored(fim.transformed(_table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", fim.text_digest("output").alias("output_sha256"),
        fim.text_digest("restored").alias("restored_sha256"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return sql.SQL
