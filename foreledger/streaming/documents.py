"""A stream of whole JSON documents: each is built or quarantined once, whatever is sent again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreledger.plans import corpus

TABLES = ("facts", "matches", "quarantine")


def read_document_stream(spark: SparkSession, path: str, files_per_trigger: int = 10_000) -> DataFrame:
    """(match_id, raw) of a growing folder of documents, a file each under ``match_id=<id>/``."""
    return (
        spark.readStream.schema("value string, match_id string").option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_trigger).text(path)
        .select("match_id", F.col("value").alias("raw")))


def route_documents(docs: DataFrame, bounds: DataFrame, path: str, checkpoint: str):
    """Build every document of a stream into the tables under ``path``; returns the running query.

    A document is self-contained, so a micro-batch is built like any other set of
    documents, against split bounds frozen before.  Its key is remembered in the state
    store: a document that is sent again, in the same micro-batch, a later one or after a
    restart, changes nothing.  A micro-batch writes a folder of its own number over an
    earlier try, so a failure between the tables and the commit repeats no row.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        built = corpus.build(batch, bounds=bounds)
        for name in TABLES:
            getattr(built, name).write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")

    return (
        docs.dropDuplicates(["match_id"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
