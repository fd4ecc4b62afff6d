"""Sinks: partitioned fact table, typed dimensions, quarantine CSV, metrics JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a declared schema, in its column order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_facts(
    df: DataFrame, path: str, schema: T.StructType,
    partition_by: Sequence[str] = ("temporal_split",), mode: str = "overwrite",
) -> None:
    """Write the fact table in its declared schema, partitioned for pruning."""
    cast_to(df, schema).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_dimension(
    df: DataFrame, path: str, schema: T.StructType, mode: str = "overwrite"
) -> None:
    cast_to(df, schema).write.mode(mode).parquet(path)


def write_quarantine(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        df.select("match_id", "reason", "detail")
        .write.mode(mode).csv(path, header=True, escape='"')
    )


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
