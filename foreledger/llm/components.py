"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreledger.sources.stored import drop_stored, stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with the least neighbour of u, u itself included."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _pairs(edges: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """Several (u, v) out of every row, which is read once."""
    return edges.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])))


def _round(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _pairs(_with_least(large), ("v", "m"), ("u", "m")).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; the root is its component's least node.

    ``edges`` has two long columns (u, v); loops are dropped.  Every round keeps the
    components and at most the number of edges, and is written to the shared folder, so
    lineage stays one round long.  Neighbourhoods are only ever reduced to their minimum:
    a hub is aggregated before the shuffle, never collected.  The loop ends when a round
    changes nothing, after O(log^2 n) rounds.
    """
    here = stored(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(here)
    while True:
        there = stored(_round(here), "edges")
        now = _mark(there)
        drop_stored(here)
        here = there
        if now == mark:
            return here.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
