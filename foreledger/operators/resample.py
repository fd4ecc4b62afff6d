"""Group-level bootstrap and frozen decision rules.

Whole groups are resampled, never rows.  Losses are first summed per group;
every replicate then draws as many groups as there are, with replacement.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.functions.scalar import nats_to_bits, seeded_index
from foreledger.operators.scan import dense_index
from foreledger.sources.stored import stored

# Replicates, seed, and the percentile interval.
B_RESAMPLES = 10_000
BOOTSTRAP_SEED = 90210
INTERVAL = (0.025, 0.975)
# Group tables travel to the draws in pieces of this many rows; a pass over the draws holds some pieces.
BROADCAST_GROUPS, PASS_PIECES = 1_000_000, 8
# Replicates that meet the groups' sums together, and draws made at a time.
BATCH, SLAB = 4, 1 << 16


def draws(spark, n_groups: int, n_boot: int = B_RESAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(replicate, idx): n_groups uniform draws with replacement per replicate."""
    r = spark.range(n_boot * n_groups).select(
        F.expr(f"id div {n_groups}").alias("replicate"), (F.col("id") % n_groups).alias("j"))
    return seeded_index(r, seed, "replicate", "j", n_groups, "idx").select("replicate", "idx")


def replicate_sums(losses: DataFrame, key: Sequence[str], sums: Sequence[str], count: str = "n",
                   n_boot: int = B_RESAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Totals of every sum and of the count per replicate: (replicate, n, sums...).

    Every task makes all draws of whole replicates and counts how often each group
    came; the counts then meet the groups' sums as a matrix product.  The sums are
    broadcast piece by piece.  A pass over the draws holds PASS_PIECES of them, so its
    memory is bounded, and nothing is shuffled but one row a replicate and pass.
    The draws are those of :func:`draws`.
    """
    n_groups = losses.count()
    if not 0 < n_groups < 2**31:
        raise ValueError(f"bootstrap needs 1..2**31-1 groups, got {n_groups}")
    spark, cols = losses.sparkSession, [count, *sums]
    table = dense_index(losses, key, "idx").select("idx", *[F.col(c).cast("double") for c in cols])
    if n_groups > BROADCAST_GROUPS:
        table = stored(table, "draws")
    schema = ", ".join(["replicate long", "n double", *[f"{s} double" for s in sums]])

    def sent(lo: int, hi: int):
        local = table.filter(F.col("idx").between(lo, hi - 1)).toArrow().sort_by("idx")
        mat = np.column_stack([local.column(c).to_numpy() for c in cols])
        whole = np.isfinite(mat)
        # Sums that are no numbers count only where their group is drawn: zero times them is not zero.
        odd = np.flatnonzero(~whole.all(axis=1))
        return spark.sparkContext.broadcast((np.where(whole, mat, 0.0), odd, np.where(whole, 0.0, mat)[odd]))

    def one_pass(lo: int, hi: int) -> DataFrame:
        starts = range(lo, hi, BROADCAST_GROUPS)
        pieces = [sent(at, min(at + BROADCAST_GROUPS, hi)) for at in starts]

        def draw(batches):
            held = [p.value for p in pieces]
            for b in batches:
                reps = b.column(0).to_numpy()
                out = np.concatenate([
                    _totals(np.stack([draw_counts(seed, int(r), n_groups, lo, hi) for r in reps[at:at + BATCH]]), held)
                    for at in range(0, len(reps), BATCH)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps), *[pa.array(out[:, j]) for j in range(out.shape[1])]],
                    ["replicate", "n", *sums])

        return spark.range(n_boot).mapInArrow(draw, schema)

    step = BROADCAST_GROUPS * PASS_PIECES
    passes = [one_pass(lo, min(lo + step, n_groups)) for lo in range(0, n_groups, step)]
    if len(passes) == 1:
        return passes[0]
    return reduce(DataFrame.unionByName, passes).groupBy("replicate").agg(
        *[F.sum(c).alias(c) for c in ("n", *sums)])


def _totals(counts: np.ndarray, held: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Counts of some replicates times the groups' sums, slab by slab."""
    out, at = np.zeros((len(counts), held[0][0].shape[1])), 0
    for mat, odd, values in held:
        for row, value in zip(odd, values):
            out[counts[:, at + row] > 0] += value
        for lo in range(0, len(mat), SLAB):
            some = mat[lo:lo + SLAB]
            out += counts[:, at:at + len(some)].astype(float) @ some
            at += len(some)
    return out


def draw_indices(seed: int, replicate: int, n: int) -> Iterator[np.ndarray]:
    """The n indices of one replicate, slab by slab, by the arithmetic of ``seeded_index``."""
    factor = np.uint64(73244475)
    start = int(replicate + seed)
    for _ in range(2):
        start = (((start >> 16) ^ start) * 73244475) & 0xFFFFFFFF
    start = (start >> 16) ^ start
    for lo in range(0, n, SLAB):
        # The first factor meets 33 bits, what follows 32.
        x = np.arange(start + lo, start + min(lo + SLAB, n), dtype=np.uint64)
        x ^= x >> np.uint64(16)
        x *= factor
        y = x.astype(np.uint32)
        y ^= y >> np.uint32(16)
        y *= np.uint32(73244475)
        y ^= y >> np.uint32(16)
        x = y.astype(np.uint64)
        x *= np.uint64(n)
        x >>= np.uint64(32)
        yield x.view(np.int64)


def draw_counts(seed: int, replicate: int, n: int, lo: int, hi: int, kind: type = np.uint8) -> np.ndarray:
    """How often one replicate draws each group of [lo, hi).

    Counts are about one, so a byte holds them; where one ran over, their total is too small and all are taken again.
    """
    counts, drawn = np.zeros(hi - lo, kind), 0
    for idx in draw_indices(seed, replicate, n):
        if hi - lo < n:
            idx = idx[(idx >= lo) & (idx < hi)] - lo
        np.add.at(counts, idx, kind(1))
        drawn += len(idx)
    if int(counts.sum(dtype=np.int64)) != drawn:
        return draw_counts(seed, replicate, n, lo, hi, np.int64)
    return counts


def intervals(losses: DataFrame, key: Sequence[str], metrics: Sequence[str], n_boot: int = B_RESAMPLES,
              seed: int = BOOTSTRAP_SEED, reps: DataFrame | None = None) -> DataFrame:
    """(metric, point, lo, hi, excludes_zero) of each mean, all from one pass of draws.

    ``reps`` holds the replicates' totals of these sums, when they are there already.
    """
    reps = replicate_sums(losses, key, metrics, n_boot=n_boot, seed=seed) if reps is None else reps
    ci = reps.agg(*[
        F.percentile(F.col(m) / F.col("n"), F.array(*map(F.lit, INTERVAL))).alias(m)
        for m in metrics])
    pt = losses.agg(*[(F.sum(m) / F.sum("n")).alias(f"__{m}") for m in metrics])
    wide = ci.withColumns({f"__{m}": pt.select(f"__{m}").scalar() for m in metrics})
    return _stack(wide, metrics)


def paired_deltas(losses: DataFrame, key: Sequence[str], pairs: dict[str, tuple[str, str]], n_boot: int = B_RESAMPLES,
                  seed: int = BOOTSTRAP_SEED, reps: DataFrame | None = None) -> DataFrame:
    """Interval of metric(a) - metric(b) with the same draws for both, per named pair; ``reps`` as in ``intervals``."""
    cols = sorted({c for ab in pairs.values() for c in ab})
    reps = replicate_sums(losses, key, cols, n_boot=n_boot, seed=seed) if reps is None else reps
    delta = lambda a, b: F.col(a) / F.col("n") - F.col(b) / F.col("n")
    ci = reps.agg(*[
        F.percentile(delta(a, b), F.array(*map(F.lit, INTERVAL))).alias(k)
        for k, (a, b) in pairs.items()])
    pt = losses.agg(*[(F.sum(a) / F.sum("n") - F.sum(b) / F.sum("n")).alias(f"__{k}")
                      for k, (a, b) in pairs.items()])
    wide = ci.withColumns({f"__{k}": pt.select(f"__{k}").scalar() for k in pairs})
    return _stack(wide, list(pairs))


def _stack(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"__{m}").alias("point"), F.col(m)[0].alias("lo"),
        F.col(m)[1].alias("hi")) for m in names])
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("excludes_zero", excludes_zero(F.col("lo"), F.col("hi")))


def excludes_zero(lo: Column, hi: Column) -> Column:
    return (lo > 0.0) | (hi < 0.0)


# Bars of the challenger rule and of the four-band verdict.
MIN_RELATIVE = 0.005
MAX_ECE_WORSENING = 0.005
REL_JUSTIFY = 1.0
REL_AMBIGUOUS = 0.3


def challenger_rule(df: DataFrame) -> DataFrame:
    """Three clauses over rows with val/test delta intervals, baseline NLL and both ECEs.

    Needs ``{val,test}_{point,lo,hi}, baseline_nll, challenger_ece, baseline_ece``.
    """
    better = lambda s: (F.col(f"{s}_point") < 0) & excludes_zero(
        F.col(f"{s}_lo"), F.col(f"{s}_hi"))
    return df.withColumns({
        "clause1": better("val") & better("test"),
        "rel_improvement": -F.col("test_point") / F.col("baseline_nll"),
        "ece_worsening": F.col("challenger_ece") - F.col("baseline_ece"),
    }).withColumns({
        "clause2": F.col("rel_improvement") >= MIN_RELATIVE,
        "clause3": F.col("ece_worsening") <= MAX_ECE_WORSENING,
    }).withColumn("beats_bar", F.col("clause1") & F.col("clause2") & F.col("clause3"))


def verdict(df: DataFrame) -> DataFrame:
    """Four bands over rows with ``point, hi, base_nll, canary_passed``."""
    rel = -F.col("point") / F.col("base_nll") * 100.0
    sure = F.col("hi") < 0.0
    band = (
        F.when(~F.col("canary_passed"), "VOID")
        .when(sure & (F.col("rel_pct") >= REL_JUSTIFY), "JUSTIFIES_TOWER")
        .when(sure & (F.col("rel_pct") >= REL_AMBIGUOUS), "AMBIGUOUS").otherwise("KILL_BRANCH"))
    return df.withColumns({"rel_pct": rel, "bits": nats_to_bits(-F.col("point"))}).withColumn(
        "verdict", band)


def floor_bound(train: DataFrame, y: str, k: int) -> DataFrame:
    """How far the add-one floor can move a score: (max_dlog, nll_bound)."""
    c = train.groupBy(y).agg(F.count(F.lit(1)).alias("c"))
    n = c.agg(F.sum("c")).scalar()
    d = c.withColumn("n", n).select(
        (F.col("c") / F.col("n")).alias("raw"),
        F.abs(F.log((F.col("c") + 1.0) / (F.col("n") + k)) - F.log(F.col("c") / F.col("n"))).alias("d"))
    return d.agg(F.max("d").alias("max_dlog"), F.sum(F.col("raw") * F.col("d")).alias("nll_bound"))
