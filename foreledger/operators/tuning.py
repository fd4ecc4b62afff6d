"""Tuning curves: every grid point is a column of one aggregate over the rows.

A grid of a few values is fixed by parameter, so the rows are read once and
never multiplied; the curve comes back as a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.functions.scalar import EPS_BOARD, log_floor, total
from foreledger.functions.variants import let
from foreledger.operators.increments import causal_sums
from foreledger.operators.tables import entity_counts, laplace_marginal, offset_of


def curve(df: DataFrame, losses: Sequence[tuple[float, Column]], param: str = "param",
          out: str = "nll") -> DataFrame:
    """Mean loss per grid point: (param, out)."""
    wide = df.agg(*[F.avg(e).alias(f"__{i}") for i, (_, e) in enumerate(losses)])
    rows = F.array(*[F.struct(F.lit(float(v)).alias(param), F.col(f"__{i}").alias(out))
                     for i, (v, _) in enumerate(losses)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def nll_of_logits(z: Column, y: Column, temperature: Column | float = 1.0) -> Column:
    """-log softmax(z / T)[y], as a log-sum of differences."""
    t = F.lit(float(temperature)) if not isinstance(temperature, Column) else temperature
    of = y.cast("int") + 1
    return let(z, lambda v: let(F.element_at(v, of), lambda zy: F.log(total(F.transform(v, lambda x: F.exp((x - zy) / t))))))


def temperature_curve(df: DataFrame, probs: str, y: str, grid: Sequence[float]) -> DataFrame:
    src = df.select(log_floor(F.col(probs)).alias("z"), F.col(y).alias("y"))
    return curve(src, [(t, nll_of_logits(F.col("z"), F.col("y"), t)) for t in grid], "temperature")


def arg_min(c: DataFrame, param: str, score: str, out: str = "best") -> DataFrame:
    """Grid value of the lowest score; the smallest parameter wins a tie."""
    return c.agg(F.min_by(param, F.struct(score, param)).alias(out))


def lambda_logits(df: DataFrame, train: DataFrame, probs: str, y: str, k: int,
                  entities: Sequence[str]) -> DataFrame:
    """Rows with base logits ``z`` and, per entity, count vectors and totals.

    Offsets are a function of the counts, so one fit serves every strength.
    """
    q = laplace_marginal(train, y, k).select("probs").scalar()
    out = df.withColumns({"z": log_floor(F.col(probs), EPS_BOARD), "__q": q})
    zeros = F.array(*[F.lit(0.0)] * k)
    for i, e in enumerate(entities):
        c = entity_counts(train, e, y, k).select(
            F.col(e).alias("__e"), F.col("n").alias(f"__n{i}"), F.col("counts").alias(f"__c{i}"))
        out = out.join(c, F.col(e) == F.col("__e"), "left").drop("__e").withColumns({
            f"__n{i}": F.coalesce(f"__n{i}", F.lit(0)), f"__c{i}": F.coalesce(f"__c{i}", zeros)})
    return out


def lambda_shifted(lam: Column | float, n_entities: int) -> Column:
    """Logits of ``lambda_logits`` rows at one strength; unseen entities shift nothing."""
    lam = F.lit(float(lam)) if not isinstance(lam, Column) else lam
    z = F.col("z")
    for i in range(n_entities):
        off = offset_of(F.col(f"__c{i}"), F.col(f"__n{i}"), F.col("__q"), lam)
        z = F.zip_with(z, off, lambda a, b: a + b)
    return z


def lambda_curve(train: DataFrame, val: DataFrame, probs: str, y: str, k: int,
                 entities: Sequence[str], grid: Sequence[float],
                 temperature: Column | float = 1.0) -> DataFrame:
    """Val NLL per strength of the entity effects: (param, nll)."""
    rows = lambda_logits(val, train, probs, y, k, entities)
    return curve(rows, [(lam, nll_of_logits(lambda_shifted(lam, len(entities)), F.col(y), temperature))
                        for lam in grid])


def tilted_logits(kappa: float, valence: Sequence[float], vbar: Column, tau: Column) -> Column:
    """Logits of rows with ``z, sum_before, n_before`` tilted by their causal mean."""
    theta = F.col("sum_before") / (F.col("n_before") + F.lit(float(kappa)))
    v = F.array(*[F.lit(float(x)) for x in valence])
    return F.zip_with("z", v, lambda a, x: a + theta * (x - vbar) / tau)


def kappa_curve(df: DataFrame, probs: str, y: str, signal: str, group: Sequence[str],
                order: Sequence[str], valence: Sequence[float], vbar: Column, tau: Column,
                grid: Sequence[float], chunk: Sequence[Column] = ()) -> DataFrame:
    """NLL per shrinkage strength of the causal latent; its sums are taken once."""
    s = causal_sums(df, F.col(signal), group, order, chunk).withColumn("z", log_floor(F.col(probs)))
    return curve(s, [(k, nll_of_logits(tilted_logits(k, valence, vbar, tau), F.col(y)))
                     for k in grid])
