"""Columnar and CSV sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUARANTINE_SCHEMA = "match_id string, reason string, detail string"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan a Parquet table; a given schema is used as is, never inferred."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Scan a quarantine CSV written by :func:`foreledger.sources.sinks.write_quarantine`."""
    return spark.read.schema(QUARANTINE_SCHEMA).csv(path, header=True, escape='"', multiLine=False)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Scan a folder of JSON documents, one group per file: (match_id, raw).

    The key is the file name without its suffix.  Each file is one row, so a
    document is never split; the folder is read in parallel.
    """
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return (
        spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
        .select(F.url_decode(stem).alias("match_id"), F.col("value").alias("raw"))
    )

