"""Increments on a frozen base forecast: causal latents and entity effects."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreledger.functions.scalar import EPS_BOARD, arg_max, dot, log_floor, outer_scale, softmax
from foreledger.operators.scan import join_on, running
from foreledger.sources.stored import stored

# Grids of the two tuned strengths and the near-unshrunk setting.
KAPPA_GRID = (2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 600.0)
LAMBDA_GRID = (25.0, 50.0, 100.0, 200.0, 400.0, 800.0, 1600.0, 3200.0)
LAMBDA_FLAT = 0.01


def causal_sums(df: DataFrame, signal: Column, group: Sequence[str], order: Sequence[str],
                chunk: Sequence[Column] = ()) -> DataFrame:
    """Append ``sum_before`` and ``n_before`` (the zero-based ordinal)."""
    return running(df, group, order, chunk=chunk,
                   sums={"sum_before": signal.cast("double"), "n_before": F.lit(1)})


def causal_mean(df: DataFrame, signal: Column, group: Sequence[str], order: Sequence[str],
                kappa: float, chunk: Sequence[Column] = (), out: str = "theta") -> DataFrame:
    """Shrunken running mean over strictly earlier rows; the prior mean 0 at the start."""
    if kappa <= 0:
        raise ValueError(f"shrinkage needs a strength above zero, not {kappa}")
    s = causal_sums(df, signal, group, order, chunk)
    theta = F.col("sum_before") / (F.col("n_before") + F.lit(float(kappa)))
    return s.select(*df.columns, "n_before", theta.alias(out))


def local_level(df: DataFrame, signal: str, group: Sequence[str], order: Sequence[str], *,
                prior_var: float = 1.0, obs_var: float = 1.0, process_var: float = 0.0,
                chunk: Sequence[Column] = (), out: str = "theta") -> DataFrame:
    """Local-level filter mean before each row, with process noise.

    The gain depends on the row's ordinal alone, and the update is affine,
    m' = (1-g) m + g x, so the filter is a weighted running sum.  Without
    process noise it is the shrunken running mean with kappa = obs/prior.  With
    noise the weights fade geometrically: rows are cut by ordinal into blocks
    long enough that a block shrinks what came before it by exp(-40), below
    double precision in size.  A block is an affine map of the mean it starts
    with; those maps are composed over chunks of blocks.
    """
    a, q, p0 = float(obs_var), float(process_var), float(prior_var)
    if q == 0.0:
        return causal_mean(df, F.col(signal), group, order, a / p0, chunk, out).drop("n_before")
    # Predicted variance: p -> ((a+q)p + aq)/(p+a), solved through its fixed points.
    root = math.sqrt(q * q + 4.0 * a * q)
    hi, lo = (q + root) / 2.0, (q - root) / 2.0
    block = max(2, math.ceil(40.0 / math.log1p(hi / a)))
    src = running(df, group, order, sums={"__i": F.lit(1)}, chunk=chunk)
    fade = F.lit((p0 - hi) / (p0 - lo)) * F.pow(
        F.lit((lo + a) / (hi + a)), F.col("__i").cast("double"))
    var = (F.lit(hi) - fade * F.lit(lo)) / (1.0 - fade)
    keys = [*group, "__blk"]
    src = src.withColumn("__blk", F.floor(F.col("__i") / block)).withColumn("__p", var)
    src = src.withColumns({
        "__gx": F.col("__p") / (F.col("__p") + a) * F.col(signal),
        "__lk": F.log(F.lit(a) / (F.col("__p") + a)),
    })
    w = Window.partitionBy(*keys).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    src = src.withColumn("__before", F.coalesce(F.sum("__lk").over(w), zero))
    src = src.withColumn("__t", F.col("__gx") * F.exp(-F.col("__before") - F.col("__lk")))
    local = src.withColumn("__s", F.coalesce(F.sum("__t").over(w), zero))
    # A block turns the mean m it starts with into keep * (m + tot).
    keep, tot = F.exp(F.sum("__lk")), F.sum("__t")
    blocks = stored(src.groupBy(*keys).agg(keep.alias("scale"), (keep * tot).alias("shift")), "blocks")
    carried = affine_prefix(blocks, group, "__blk").withColumnRenamed("start", "__m")
    local = join_on(local, carried, keys, "left")
    return local.select(*df.columns, (F.exp("__before") * (F.col("__s") + F.coalesce("__m", zero))).alias(out))


def affine_prefix(maps: DataFrame, group: Sequence[str], at: str, fan: int = 256) -> DataFrame:
    """(group, at, start): the value with which each map ``m -> scale * m + shift`` starts.

    The maps of a group are applied in the order of the whole number ``at``, from 0.  Maps
    compose to a map, so ``fan`` neighbours become one row, that level is solved in the same
    way, and its values are carried down again.  No row holds more than ``fan`` maps.
    """
    chunk = f"{at}__up"
    step = F.struct(F.col(at).alias("at"), "scale", "shift")
    chunks = maps.withColumn(chunk, F.floor(F.col(at) / fan)).groupBy(*group, chunk).agg(
        F.sort_array(F.collect_list(step)).alias("steps"))
    one = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"))
    whole = F.aggregate("steps", one, lambda m, s: F.struct(
        (m["scale"] * s["scale"]).alias("scale"), (s["scale"] * m["shift"] + s["shift"]).alias("shift")))
    if (maps.agg(F.max(at)).first()[0] or 0) >= fan:
        chunks = stored(chunks, "maps")
        above = affine_prefix(chunks.select(*group, chunk, whole.alias("m")).select(*group, chunk, "m.*"), group, chunk, fan)
        chunks = join_on(chunks, above, [*group, chunk])
    else:
        chunks = chunks.withColumn("start", F.lit(0.0))
    empty = F.array().cast("array<struct<at: long, start: double>>")
    walk = F.aggregate(
        "steps", F.struct(F.col("start").alias("m"), empty.alias("seen")),
        lambda w, s: F.struct(
            (s["scale"] * w["m"] + s["shift"]).alias("m"),
            F.concat(w["seen"], F.array(F.struct(s["at"].cast("long").alias("at"), w["m"].alias("start")))).alias("seen")),
        lambda w: w["seen"])
    return chunks.select(*group, F.explode(walk).alias("s")).select(*group, F.col("s.at").alias(at), F.col("s.start").alias("start"))


def valence_moments(probs: Column, valence: Sequence[float]) -> tuple[Column, Column]:
    """Mean and variance of a class valence under a probability vector."""
    v = F.array(*[F.lit(float(x)) for x in valence])
    v2 = F.array(*[F.lit(float(x) ** 2) for x in valence])
    mean = dot(probs, v)
    return mean, dot(probs, v2) - mean * mean


def residual_signal(probs: Column, y: Column, valence: Sequence[float]) -> Column:
    """Valence of the outcome minus its expectation under the base forecast."""
    v = F.array(*[F.lit(float(x)) for x in valence])
    return F.element_at(v, y.cast("int") + 1) - dot(probs, v)


def tilt(probs: Column, theta: Column, valence: Sequence[float], vbar: Column, tau: Column,
         eps: float = EPS_BOARD) -> Column:
    """Exponential tilt of a forecast along the centred valence."""
    v = F.array(*[F.lit(float(x)) for x in valence])
    shift = outer_scale(theta, F.transform(v, lambda x: (x - vbar) / tau))
    return softmax(F.zip_with(log_floor(probs, eps), shift, lambda a, b: a + b))


def unimodal(curve: DataFrame, param: str, score: str, tol: float = 1e-12) -> DataFrame:
    """One row (best, unimodal) for a tuning curve of a few grid points.

    The first minimum wins; the curve must not rise before it nor fall after it.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col(param).alias("x"), F.col(score).alias("s"))))
    c = curve.agg(rows.alias("c")).withColumn("s", F.transform("c", lambda r: r["s"]))
    at = arg_max(F.transform("s", lambda x: -x))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("s") - 1),
        lambda i: F.when(i <= F.col("at"), F.col("s")[i] - F.col("s")[i - 1] <= tol)
        .otherwise(F.col("s")[i] - F.col("s")[i - 1] >= -tol),
    )
    return (
        c.withColumn("at", at.cast("int"))
        .select(F.col("c")[F.col("at")]["x"].alias("best"),
                F.forall(steps, lambda b: b).alias("is_unimodal"))
    )
