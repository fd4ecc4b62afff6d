"""Column functions: clipping, links, array maths, bands, seeded hashing.

All are compositions of built-in Spark functions, so they stay in the JVM.
Probability vectors are ``array<double>`` columns that travel with their row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.functions.variants import let

# Probability floors of the metric library and of the leaderboard.
EPS = 1e-15
EPS_BOARD = 1e-12

__all__ = [
    "EPS", "EPS_BOARD", "clip", "logit", "sigmoid", "softmax", "total", "shared_out", "log_floor", "one_hot",
    "dot", "outer_scale", "arg_max", "band_right", "band_left", "bands_of", "safe_div",
    "nats_to_bits", "flag", "fill_zero", "text_or", "iso_date", "is_digits",
    "null_if_empty", "sha256_text", "mix32", "seeded_index", "hex_word", "key_text",
]


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, lo: float | None, hi: float | None) -> Column:
    if lo is not None:
        x = F.greatest(x, F.lit(float(lo)))
    if hi is not None:
        x = F.least(x, F.lit(float(hi)))
    return x


def logit(p: Column, eps: float = EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def total(a: Column) -> Column:
    """Sum of an array's elements, from the first to the last."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def shared_out(a: Column) -> Column:
    """Every element over the total; the array and its total are evaluated once a row."""
    return let(a, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))


def softmax(z: Column) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    shifted = let(z, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    return shared_out(shifted)


def log_floor(p: Column, eps: float = EPS_BOARD) -> Column:
    """Element-wise log of a probability array, floored at ``eps``."""
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(eps))))


def one_hot(y: Column, k: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == y, 1.0).otherwise(0.0)
    )


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def outer_scale(scalar: Column, direction: Column) -> Column:
    """One row of an outer product: every element of ``direction`` times a scalar."""
    return F.transform(direction, lambda d: d * scalar)


def arg_max(p: Column) -> Column:
    """Zero-based position of the largest element; the first one wins a tie."""
    return F.array_position(p, F.array_max(p)) - 1


def band_right(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are <= x (right-sided search)."""
    return _band([F.when(x >= F.lit(e), 1).otherwise(0) for e in edges])


def band_left(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are < x (left-sided search)."""
    return _band([F.when(x > F.lit(e), 1).otherwise(0) for e in edges])


def _band(hits: list[Column]) -> Column:
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total.cast("int")


def bands_of(x: Column, edges: Column) -> Column:
    """Right-sided search against an array column of edges."""
    return F.size(F.filter(edges, lambda e: e <= x))


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """Division that never raises under ANSI; ``default`` where the divisor is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(default).cast("double"))


def nats_to_bits(x: Column) -> Column:
    return x / F.lit(math.log(2.0))


def flag(cond: Column) -> Column:
    """0/1 double; null conditions stay null."""
    return cond.cast("double")


def fill_zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def text_or(x: Column, default: str) -> Column:
    return F.coalesce(x.cast("string"), F.lit(default))


def iso_date(x: Column) -> Column:
    """ISO date, or null when the text is not one."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x)).when(
        x.rlike(r"^\d{8}$"), F.try_to_date(x, "yyyyMMdd"))


def is_digits(x: Column) -> Column:
    return x.rlike("^[0-9]+$")


def null_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def sha256_text(x: Column) -> Column:
    return F.sha2(x, 256)


def key_text(*cols: Column, missing: str = "None") -> Column:
    """Canonical ``:``-joined text.  Nulls become a word, never vanish."""
    return F.concat_ws(":", *[text_or(c, missing) for c in cols])


def hex_word(digest: Column, i: int) -> Column:
    """The i-th 32-bit word of a hex digest as a long."""
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")


def mix32(df: DataFrame, source: str, out: str) -> DataFrame:
    """Append an avalanche of a non-negative long column to 32 bits.

    Two multiply/xor-shift rounds.  Products stay below 2**59, so nothing
    overflows under ANSI, and plain SQL can repeat the arithmetic.  Each round
    is its own projection, so a round is worked out once per row.
    """
    fold = lambda c: F.shiftright(c, 16).bitwiseXOR(F.col(c))
    at = source
    for i in range(2):
        nxt = f"__{out}{i}"
        df = df.withColumn(nxt, (fold(at) * F.lit(73244475)).bitwiseAND(F.lit(4294967295)))
        at = nxt
    return df.withColumn(out, fold(at)).drop(*[f"__{out}{i}" for i in range(2)])


def seeded_index(df: DataFrame, seed: int, stream: str, step: str, size: int, out: str) -> DataFrame:
    """Append a uniform index in [0, size) for (seed, stream, step); size < 2**31."""
    df = mix32(df.withColumn("__s", F.col(stream) + F.lit(seed)), "__s", "__h")
    df = mix32(df.withColumn("__t", F.col("__h") + F.col(step)), "__t", "__g")
    return df.withColumn(out, F.shiftright(F.col("__g") * F.lit(size).cast("long"), 32)).drop(
        "__s", "__h", "__t", "__g")
