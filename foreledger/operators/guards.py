"""Leakage canaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreledger.operators.scan import dense_index

# Tolerances of the canaries, and the permutation seed.
EPS_SHUFFLE = 0.01
EPS_B2_VS_B0 = 0.001
EPS_B3_VS_B2 = 0.005
SEED = 1337


def shuffle_labels(df: DataFrame, y: str, key: Sequence[str], seed: int = SEED,
                   hex_digits: int = 3) -> DataFrame:
    """Permute a label with few values over rows, keeping every class count.

    Rows get a hash-scattered dense number; class k takes the numbers between
    the running class counts.  That is a uniform permutation without a join.
    """
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.select(F.col(y).alias("v"), F.sum("n").over(
        Window.orderBy(y).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("hi"))
    steps = upto.agg(F.sort_array(F.collect_list(F.struct("hi", "v"))).alias("s")).select("s").scalar()
    idx = dense_index(df, key, "__i", salt=f"{seed}:", hex_digits=hex_digits).withColumn("__s", steps)
    hit = F.filter("__s", lambda s: s["hi"] > F.col("__i"))[0]
    return idx.withColumn(y, hit["v"]).drop("__i", "__s")


def shuffle_column(df: DataFrame, col: str, key: Sequence[str], seed: int = SEED,
                   hex_digits: int = 3) -> DataFrame:
    """Permute a column with many values: two dense numberings meet in a join."""
    to = dense_index(df.drop(col), key, "__i", salt=f"{seed}:{col}:to:", hex_digits=hex_digits)
    src = dense_index(df.select(*key, col), key, "__i", salt=f"{seed}:{col}:from:",
                      hex_digits=hex_digits).select("__i", col)
    return to.join(src, "__i").select(*df.columns)


def shuffle_columns(df: DataFrame, cols: Sequence[str], key: Sequence[str],
                    seed: int = SEED) -> DataFrame:
    """Independent permutations of several columns."""
    for c in cols:
        df = shuffle_column(df, c, key, seed)
    return df


def shuffle_canary(shuffled: Column, baseline: Column, eps: float = EPS_SHUFFLE) -> dict[str, Column]:
    """Delta of a model fitted on shuffled data to its baseline, pass flag, leak flag."""
    d = shuffled - baseline
    return {"delta": d, "passed": F.abs(d) <= eps, "leaks": d < -eps}


def ladder_inversion(b0: Column, b2: Column, b3: Column) -> dict[str, Column]:
    """Richer models must not score worse than simpler ones beyond a tolerance."""
    ok2, ok3 = b2 <= b0 + EPS_B2_VS_B0, b3 <= b2 + EPS_B3_VS_B2
    return {"b2_ok": ok2, "b3_ok": ok3, "passed": ok2 & ok3}


def poison_differences(clean: DataFrame, poisoned: DataFrame) -> DataFrame:
    """Rows on one side only, counted per side; both counts are 0 when nothing leaks.

    Repeats count, as in ``EXCEPT ALL``.  Rows of both sides meet once, by a 128-bit
    fingerprint that covers the places of nulls, so no wide row is shuffled or kept.
    """
    if clean.columns != poisoned.columns:
        raise ValueError(f"columns on one side only: {set(clean.columns) ^ set(poisoned.columns)}")
    cols = [F.col(c) for c in clean.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])  # a hash passes nulls over
    row = [F.xxhash64(*cols).alias("__h"), F.xxhash64(F.lit("row"), nulls, *cols).alias("__g")]
    left = clean.select(*row, F.lit(1).alias("__n"))
    right = poisoned.select(*row, F.lit(-1).alias("__n"))
    over = left.unionByName(right).groupBy("__h", "__g").agg(F.sum("__n").alias("__n"))
    n = over.agg(*[F.coalesce(F.sum(F.greatest(sign * F.col("__n"), F.lit(0))), F.lit(0)).alias(side)
                   for side, sign in (("clean", 1), ("dirty", -1))])
    return n.select(F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(side).alias("n")) for side in ("clean", "dirty")])).alias("r")).select("r.*")
