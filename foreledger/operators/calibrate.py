"""Calibration maps, fitted on the validation split only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreledger.functions.scalar import EPS, bands_of, clip, dot, log_floor, logit, sigmoid, softmax
from foreledger.functions.variants import let
from foreledger.operators.metrics import mean, n_rows
from foreledger.operators.scan import running
from foreledger.sources.stored import drop_stored, stored

# Temperature bounds and the thin-cell threshold in labelled groups.
T_BOUNDS = (0.05, 20.0)
THIN_CELL = 300
# Every pass that is not a Newton step halves the bracket, so this many always do.
MAX_PASSES = 100
# Pools that one task takes in the isotonic fit.
BLOCK_ROWS = 200_000


def temperature_probs(probs: Column, t: float | Column) -> Column:
    """softmax(log p / T)."""
    return softmax(F.transform(log_floor(probs), lambda x: x / t))


def fit_temperature(val: DataFrame, probs: str, y: str) -> float:
    """T with the lowest val NLL in T_BOUNDS, over rows that are written once."""
    rows = stored(val.select(log_floor(F.col(probs)).alias("z"), F.col(y).cast("int").alias("y")))
    return fit_temperatures(rows, [F.col("z")], "y")[0]


def _slope_and_curvature(z: Column, y: Column, b: float) -> Column:
    """E[z] - z_y and Var[z] of a row under softmax(b z)."""
    def moments(v: Column, w: Column) -> Column:
        return let(dot(w, v), lambda m: F.struct(
            (m - F.element_at(v, y.cast("int") + 1)).alias("g"),
            (dot(w, F.transform(v, lambda x: x * x)) - m * m).alias("h")))

    return let(z, lambda v: let(softmax(F.transform(v, lambda x: x * b)), lambda w: moments(v, w)))


@dataclass
class _Bracket:
    """Safeguarded Newton search for the root of a rising slope in [lo, hi].

    Both ends are looked at first: an end at which the slope does not point back
    into the bracket is itself the best point.
    """

    lo: float = 1.0 / T_BOUNDS[1]
    hi: float = 1.0 / T_BOUNDS[0]
    b: float = 1.0
    done: bool = False

    def ends(self, at_lo: float, at_hi: float) -> None:
        if at_lo >= 0 or at_hi <= 0:
            self.b, self.done = (self.lo if at_lo >= 0 else self.hi), True

    def step(self, slope: float, curvature: float) -> None:
        self.lo, self.hi = (self.b, self.hi) if slope < 0 else (self.lo, self.b)
        nxt = self.b - slope / curvature if curvature > 0 else self.lo
        if not self.lo < nxt < self.hi:
            nxt = 0.5 * (self.lo + self.hi)
        self.done = abs(nxt - self.b) < 1e-7 * self.b or self.hi - self.lo < 1e-7 * self.lo
        self.b = nxt


def fit_temperatures(rows: DataFrame, logits: Sequence[Column], y: str, w: str | None = None) -> list[float]:
    """The best T for each of several logit columns of the same rows.

    NLL is convex in b = 1/T.  A first pass takes the slopes at both bounds; every later
    pass is one aggregate that holds the Newton step of every column that is not settled.
    Two numbers a column are fetched.  A row stands for ``w`` rows.
    """
    kept = [w] if w else []

    def moments(points: dict[str, tuple[int, float]]) -> dict:
        return rows.select(*kept, *[_slope_and_curvature(logits[i], F.col(y), b).alias(n) for n, (i, b) in points.items()]).agg(*[
            mean(F.col(n)[k], w).alias(f"{k}{n}") for n in points for k in "gh"]).first().asDict()

    at = [_Bracket() for _ in logits]
    if not at:
        return []
    edges = moments({f"{end}{i}": (i, getattr(s, end)) for i, s in enumerate(at) for end in ("lo", "hi")})
    if edges["glo0"] is None:
        raise ValueError("no rows to fit a temperature on")
    for i, s in enumerate(at):
        s.ends(edges[f"glo{i}"], edges[f"ghi{i}"])
    for _ in range(MAX_PASSES):
        live = [i for i, s in enumerate(at) if not s.done]
        if not live:
            return [min(max(1.0 / s.b, T_BOUNDS[0]), T_BOUNDS[1]) for s in at]
        got = moments({f"m{i}": (i, at[i].b) for i in live})
        for i in live:
            at[i].step(got[f"gm{i}"], got[f"hm{i}"])
    raise RuntimeError(f"no temperature found in {MAX_PASSES} passes")


def _vector(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


@dataclass(frozen=True)
class Platt:
    a: float
    b: float

    def apply(self, p: Column) -> Column:
        return sigmoid(self.a * logit(p) + self.b)


def fit_platt(val: DataFrame, p: str, y: str, w: str | None = None) -> Platt:
    """Unregularised logistic fit of the label on logit(p), over distinct (p, y) weights."""
    agg = val.groupBy(F.col(p).alias("p"), F.col(y).cast("double").alias("label")).agg(
        n_rows(w).cast("double").alias("w"))
    rows = _vector(agg.withColumn("x", logit(F.col("p"))), ["x"])
    m = LogisticRegression(regParam=0.0, maxIter=200, tol=1e-9, standardization=True,
                           weightCol="w").fit(rows)
    return Platt(float(m.coefficients[0]), float(m.intercept))


def isotonic_blocks(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pools of the weighted monotone fit: (lo, hi, value, next_lo, next_value), stored.

    ``points`` has one row (x, s, w) for every distinct score: sum and number of its labels.
    Pools merge like sums: pooling the pools of two ranges gives the pools of both.  So
    every range partition pools on its own, and the pools are cut into ranges again, at
    other borders, until no two neighbours across a border are out of order or all pools
    fit into one task of ``block_rows``.
    """
    pools = stored(points.filter("x IS NOT NULL").select(
        F.col("x").cast("double").alias("lo"), F.col("x").cast("double").alias("hi"),
        F.col("s").cast("double").alias("s"), F.col("w").cast("double").alias("w")), "pools")
    for turn in range(MAX_PASSES):
        parts = -(-pools.count() // block_rows)
        parts = parts + turn % 2 if parts > 1 else 1
        pooled = stored(pools.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(
            _pool, "lo double, hi double, s double, w double, next_lo double, next_value double").withColumn(
            "pid", F.spark_partition_id()), "pools")
        drop_stored(pools)
        value = F.col("s") / F.col("w")
        # A row for each range partition that holds a pool.
        ends = pooled.groupBy("pid").agg(
            F.min("lo").alias("start"), F.min_by(value, "lo").alias("first"), F.max_by(value, "lo").alias("last"))
        order = Window.orderBy("pid")
        borders = stored(ends.select(
            "pid", "last", F.lead("start").over(order).alias("b_lo"), F.lead("first").over(order).alias("b_value")), "borders")
        if borders.filter("last >= b_value").isEmpty():
            return pooled.join(F.broadcast(borders.select("pid", "b_lo", "b_value")), "pid").select(
                "lo", "hi", value.alias("value"), F.coalesce("next_lo", "b_lo").alias("next_lo"),
                F.coalesce("next_value", "b_value").alias("next_value"))
        pools = pooled.select("lo", "hi", "s", "w")
    raise RuntimeError(f"pools across borders are still out of order after {MAX_PASSES} rounds")


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool adjacent violators of one sorted range."""
    lo, hi, s, w = [], [], [], []
    for batch in batches:
        for a, b, c, d in zip(*(batch.column(k).to_pylist() for k in range(4))):
            while s and s[-1] * d >= c * w[-1]:
                a, c, d = lo.pop(), c + s.pop(), d + w.pop()
                hi.pop()
            lo.append(a)
            hi.append(b)
            s.append(c)
            w.append(d)
    if lo:
        value = [c / d for c, d in zip(s, w)]
        columns = [lo, hi, s, w, [*lo[1:], None], [*value[1:], None]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.float64()) for c in columns], names=["lo", "hi", "s", "w", "next_lo", "next_value"])


def apply_isotonic(df: DataFrame, src: str, blocks: DataFrame, out: str) -> DataFrame:
    """Append the fitted value: that of a pool inside it, straight lines between pools.

    Only distinct scores are placed among the pools, by a running scan cut at quantiles of
    the scores; rows meet their score's value in a join.
    """
    scores = df.select(F.col(src).cast("double").alias("x")).filter("x IS NOT NULL").distinct()
    cuts = sorted(set(scores.approxQuantile("x", [k / 64 for k in range(1, 64)], 0.002)))
    pool = F.struct("lo", "hi", "value", "next_lo", "next_value")
    both = scores.select("x", F.lit(1).alias("kind"), F.lit(None).cast(
        "struct<lo: double, hi: double, value: double, next_lo: double, next_value: double>").alias("pool")).unionByName(
        blocks.select(F.col("lo").alias("x"), F.lit(0).alias("kind"), pool.alias("pool")))
    band = bands_of(F.col("x"), F.array(*map(F.lit, cuts)).cast("array<double>"))
    placed = running(both, [], ["x", "kind"], lasts={"at": F.col("pool")}, chunk=[band]).filter("kind = 1")
    lowest = blocks.agg(F.min_by("value", "lo")).scalar()
    share = (F.col("x") - F.col("at.hi")) / (F.col("at.next_lo") - F.col("at.hi"))
    value = F.when(F.col("at").isNull(), lowest).when(
        (F.col("x") <= F.col("at.hi")) | F.col("at.next_lo").isNull(), F.col("at.value")).otherwise(
        F.col("at.value") + share * (F.col("at.next_value") - F.col("at.value")))
    table = placed.select(F.col("x").alias("__x"), clip(value, EPS, 1 - EPS).alias(out))
    return df.join(table, F.col(src).cast("double") == F.col("__x"), "left").drop("__x")


def fit_isotonic(val: DataFrame, p: str, y: str, w: str | None = None):
    """Monotone map from distinct scores with their weights: (apply_fn, pools).

    ``apply_fn(df, src, out)`` appends the clipped calibrated column.
    """
    blocks = isotonic_blocks(val.groupBy(F.col(p).alias("x")).agg(
        F.sum(F.col(y).cast("double") * (F.lit(1) if w is None else F.col(w))).alias("s"), n_rows(w).alias("w")))
    return lambda df, src, out: apply_isotonic(df, src, blocks, out), blocks


def board_calibration(n_labeled_groups: int) -> str:
    """Thin cells ship Platt; the rest ship isotonic."""
    return "platt" if n_labeled_groups < THIN_CELL else "isotonic"
