"""Increment gates on a frozen base forecast: entity effects and a causal latent.

Base rows carry keys, ``y`` and the frozen class probabilities ``base``.  Every
arm is calibrated by a temperature fitted on val and compared on the same
group draws.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.functions import EPS_BOARD, log_floor
from foreledger.functions.scalar import softmax
from foreledger.operators import calibrate as C
from foreledger.operators import guards, increments as I, resample
from foreledger.operators import metrics as M
from foreledger.operators import tables as T
from foreledger.operators import tuning
from foreledger.operators.scan import pin
from foreledger.sources.stored import stored


def augmented(df: DataFrame, train: DataFrame, lam: float, k: int, entities: Sequence[str], base: str = "base",
              out: str = "q", y: str = "y") -> DataFrame:
    """Base forecast plus shrunken entity offsets fitted on train."""
    marginal = pin(T.laplace_marginal(train, y, k))
    r, names = df, []
    for i, e in enumerate(entities):
        names.append(f"__o{i}")
        r = T.attach_offsets(r, T.entity_offsets(train, e, y, k, lam, marginal), e, k, names[-1])
    return r.withColumn(out, T.augment(F.col(base), *[F.col(n) for n in names])).drop(*names)


def tune_lambda(train: DataFrame, val: DataFrame, k: int, entities: Sequence[str], base: str = "base", y: str = "y",
                grid: Sequence[float] = I.LAMBDA_GRID) -> DataFrame:
    """(param, temperature, nll): post-temperature val NLL per strength."""
    rows = stored(tuning.lambda_logits(val, train, base, y, k, entities))
    n = len(entities)
    return _post_temperature(rows, [(lam, tuning.lambda_shifted(lam, n)) for lam in grid], y)


def _post_temperature(rows: DataFrame, arms: Sequence[tuple[float, Column]], y: str) -> DataFrame:
    """NLL of every arm at its own best temperature; all arms are fitted together."""
    floor = F.lit(math.log(EPS_BOARD))
    fitted = C.fit_temperatures(rows, [F.transform(z, lambda x: F.greatest(x, floor)) for _, z in arms], y)
    points = [(param, t, z) for (param, z), t in zip(arms, fitted)]
    wide = rows.agg(*[F.avg(tuning.nll_of_logits(z, F.col(y), t)).alias(f"__{i}") for i, (_, t, z) in enumerate(points)])
    return wide.select(F.explode(F.array(*[F.struct(
        F.lit(float(p)).alias("param"), F.lit(t).alias("temperature"), F.col(f"__{i}").alias("nll"))
        for i, (p, t, _) in enumerate(points)])).alias("r")).select("r.*")


def tune_kappa(val: DataFrame, k: int, valence: Sequence[float], vbar: float, tau: float, group: Sequence[str],
               order: Sequence[str], base: str = "base", y: str = "y", chunk: Sequence[Column] = (),
               grid: Sequence[float] = I.KAPPA_GRID) -> DataFrame:
    """(param, temperature, nll) of the causal latent per shrinkage strength."""
    sig = I.residual_signal(F.col(base), F.col(y), valence)
    s = I.causal_sums(val, sig, group, order, chunk).withColumn("z", log_floor(F.col(base)))
    rows = stored(s.select(y, "z", "sum_before", "n_before"))
    return _post_temperature(
        rows, [(kp, tuning.tilted_logits(kp, valence, F.lit(vbar), F.lit(tau))) for kp in grid], y)


def identity_gate(train: DataFrame, val: DataFrame, test: DataFrame, *, k: int, entities: Sequence[str],
                  key: Sequence[str], group: str = "match_id", y: str = "y", base: str = "base",
                  grid: Sequence[float] = I.LAMBDA_GRID, n_boot: int = resample.B_RESAMPLES) -> dict[str, DataFrame]:
    """Do entity effects improve the frozen base?  Curve, arms, deltas, dilution, verdict."""
    curve = pin(tune_lambda(train, val, k, entities, base, y, grid))
    lam = curve.orderBy("nll", "param").first()["param"]
    fits = {
        "state": (None, train), "flat": (I.LAMBDA_FLAT, train), "shrunk": (lam, train),
        "shuffled": (lam, stored(guards.shuffle_columns(
            train.select(*key, y, *[e for e in entities if e not in key]), entities, key)))}
    # Rows of val and test take the offsets of every arm together; the temperatures are then fitted in common passes.
    rows = val.withColumn("__val", F.lit(True)).unionByName(test.withColumn("__val", F.lit(False)), allowMissingColumns=True)
    for name, (strength, fit) in fits.items():
        rows = rows.withColumn(name, F.col(base)) if strength is None else augmented(
            rows, fit, strength, k, entities, base, name, y)
    rows = stored(rows.select(*dict.fromkeys([group, y, *entities]), "__val", *[log_floor(F.col(n)).alias(n) for n in fits]))
    fitted = C.fit_temperatures(rows.filter("__val"), [F.col(n) for n in fits], y)
    cooled = lambda z, t: softmax(F.transform(z, lambda x: x / t))
    scored = stored(rows.filter("NOT __val").drop("__val").withColumns({n: cooled(n, t) for n, t in zip(fits, fitted)}))
    losses = {f"nll_{n}": M.nll_multi(F.col(n), F.col(y)) for n in fits} | {
        f"brier_{n}": M.brier_multi(F.col(n), F.col(y), k) for n in ("state", "shrunk")}
    gl = stored(M.group_losses(scored, [group], losses))
    arms = pin(resample.intervals(gl, [group], list(losses), n_boot))
    deltas = pin(resample.paired_deltas(gl, [group], {
        "shrunk-state": ("nll_shrunk", "nll_state"), "flat-shrunk": ("nll_flat", "nll_shrunk"),
        "shuffled-state": ("nll_shuffled", "nll_state")}, n_boot))
    at = {r["metric"]: r["point"] for r in arms.collect()}
    canary = guards.shuffle_canary(F.lit(at["nll_shuffled"]), F.lit(at["nll_state"]))
    verdict = resample.verdict(deltas.filter("metric = 'shrunk-state'").withColumns({
        "base_nll": F.lit(at["nll_state"]), "canary_passed": canary["passed"]}))
    seen = scored
    conds = {}
    for e in entities:
        seen = T.attach_seen(seen, train, e, f"seen_{e}")
        conds |= {f"null_{e}": F.col(e).isNull(), f"unseen_{e}": ~F.col(f"seen_{e}") & F.col(e).isNotNull()}
    from foreledger.operators.census import dilution

    return {"curve": curve, "shape": I.unimodal(curve, "param", "nll"), "arms": arms, "deltas": deltas,
            "verdict": verdict, "dilution": dilution(seen, conds), "floor": resample.floor_bound(train, y, k)}
