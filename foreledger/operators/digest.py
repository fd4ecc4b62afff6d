"""Content fingerprints that merge like sums.

A group's fingerprint adds up the 32-bit words of the SHA-256 of every row's
canonical text (order keys included) and hashes the totals.  Any change, move,
loss or repeat of a row changes it, yet it aggregates partially: no group is
ever collected.  A corpus fingerprint hashes bucket fingerprints in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.functions.scalar import hex_word, key_text, sha256_text
from foreledger.operators.scan import join_on

WORDS = 4


def _fingerprint(n: Column, words: list[Column]) -> Column:
    return sha256_text(F.concat_ws(":", n.cast("string"), *[w.cast("string") for w in words]))


def group_digest(
    df: DataFrame, group: Sequence[str], text_cols: Sequence[str], out: str = "stream_hash"
) -> DataFrame:
    """One fingerprint per group; ``text_cols`` must include the order keys."""
    h = df.select(*group, sha256_text(key_text(*[F.col(c) for c in text_cols])).alias("__h"))
    wide = h.select(*group, *[
        hex_word(F.col("__h"), i).cast("decimal(20,0)").alias(f"__w{i}") for i in range(WORDS)
    ])
    agg = wide.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(f"__w{i}").alias(f"__w{i}") for i in range(WORDS)]
    )
    words = [F.col(f"__w{i}") for i in range(WORDS)]
    return agg.select(*group, _fingerprint(F.col("__n"), words).alias(out))


def corpus_digest(df: DataFrame, text_cols: Sequence[str], out: str = "corpus_hash") -> DataFrame:
    """One row: fingerprint of the ``:``-joined lines of a keyed frame (nulls read ``None``)."""
    one = group_digest(df.withColumn("__g", F.lit(0)), ["__g"], text_cols, out)
    return one.select(out)


# ---- a keyed tree of fingerprints ------------------------------------------------

DEPTH = 3


def leaf_of(key: Sequence[str], depth: int = DEPTH) -> Column:
    """Leaf of a key: the first hex digits of its MD5, so leaves hold even shares."""
    return F.substring(F.md5(key_text(*[F.col(c) for c in key])), 1, depth)


def hash_tree(df: DataFrame, key: Sequence[str], text_cols: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """(level, node, n, hash) of every range of keys, from the root (level 0) to the leaves.

    A node's fingerprint is that of all rows below it.  Word sums merge, so rows are read
    once and every level is summed from at most 16**depth leaves.
    """
    h = sha256_text(key_text(*[F.col(c) for c in text_cols]))
    rows = df.select(leaf_of(key, depth).alias("leaf"), h.alias("h")).select("leaf", *[
        hex_word(F.col("h"), i).cast("decimal(20,0)").alias(f"w{i}") for i in range(WORDS)])
    sums = [F.sum(f"w{i}").cast("decimal(38,0)").alias(f"w{i}") for i in range(WORDS)]
    leaves = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *sums)
    up = leaves.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).withColumn(
        "node", F.substring("leaf", F.lit(1), F.col("level")))
    tree = up.groupBy("level", "node").agg(F.sum("n").alias("n"), *sums)
    return tree.select("level", "node", "n", _fingerprint(F.col("n"), [F.col(f"w{i}") for i in range(WORDS)]).alias("hash"))


def tree_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, node) of every range on which two trees differ or that only one has."""
    left, right = (t.select("level", "node", F.col("hash").alias(n)) for t, n in ((a, "hash_a"), (b, "hash_b")))
    return left.join(right, ["level", "node"], "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("level", "node")


def differing_keys(a: DataFrame, b: DataFrame, key: Sequence[str], text_cols: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """(key..., n_a, n_b): keys whose rows differ between two builds, and how many rows each has.

    The trees say in which leaves to look; only rows of those leaves are compared.
    """
    apart = tree_differences(hash_tree(a, key, text_cols, depth), hash_tree(b, key, text_cols, depth))
    leaves = apart.filter(F.col("level") == depth).select(F.col("node").alias("__leaf"))
    sides = []
    for df, name in ((a, "a"), (b, "b")):
        rows = df.withColumn("__leaf", leaf_of(key, depth)).join(F.broadcast(leaves), "__leaf", "left_semi")  # 16**depth at most
        counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        marked = group_digest(rows, key, text_cols, "hash")
        sides.append(join_on(counted, marked, key).select(*key, F.col("n").alias(f"n_{name}"), F.col("hash").alias(f"hash_{name}")))
    left, right = (s.select(F.struct(*key).alias("key"), *[c for c in s.columns if c not in key]) for s in sides)
    both = left.join(right, "key", "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    return both.select("key.*", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
