"""Proper scores and calibration of scored rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.functions.scalar import EPS, EPS_BOARD, arg_max, band_right, clip, one_hot
from foreledger.operators.scan import attach_bins, equal_mass_edges, pin


# ---- row losses -----------------------------------------------------------

def nll_multi(p: Column, y: Column, eps: float = EPS) -> Column:
    return -F.log(F.greatest(F.element_at(p, y.cast("int") + 1), F.lit(eps)))


def nll_binary(p: Column, y: Column, eps: float = EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def brier_multi(p: Column, y: Column, k: int) -> Column:
    sq = F.zip_with(p, one_hot(y.cast("int"), k), lambda a, b: (a - b) * (a - b))
    return F.aggregate(sq, F.lit(0.0), lambda s, x: s + x)


def brier_binary(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def skill(metric: Column, baseline: Column) -> Column:
    return 1.0 - metric / baseline


def mean_losses(df: DataFrame, losses: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Mean of every loss in one aggregate, overall or per key."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               *[F.avg(e).alias(n) for n, e in losses.items()])


def group_losses(df: DataFrame, group: Sequence[str], losses: Mapping[str, Column]) -> DataFrame:
    """Per-group sums and the row count, the input of the bootstrap."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"),
                                  *[F.sum(e).alias(n) for n, e in losses.items()])


def loss_by_year(df: DataFrame, dates: DataFrame | None, key: str, date_col: str,
                 losses: Mapping[str, Column]) -> DataFrame:
    """Mean losses per calendar year; ``dates`` (key, date) is joined when given."""
    src = df if dates is None else df.join(dates.select(key, date_col), key, "left")
    return mean_losses(src.withColumn("year", F.year(date_col)), losses, ["year"])


def n_rows(w: str | None) -> Column:
    """Number of rows; a row stands for as many as its column ``w`` says, if one is named."""
    return F.count(F.lit(1)) if w is None else F.sum(w)


def mean(x: Column, w: str | None) -> Column:
    """Mean over rows, each as often as ``w`` says; nulls are left out."""
    return F.avg(x) if w is None else F.sum(x * F.col(w)) / F.sum(F.when(x.isNotNull(), F.col(w)))


# ---- calibration over equal-mass bins --------------------------------------

def reliability(df: DataFrame, p: str, y: Column | str, by: Sequence[str] = (),
                n_bins: int | Column = 20, w: str | None = None) -> DataFrame:
    """Per bin: n, p_mean, y_mean, weight.  Bins are equal-mass; ties share a bin.  A row stands for ``w`` rows."""
    group, kept = list(by) or ["__all"], [w] if w else []
    y = F.col(y) if isinstance(y, str) else y
    src = df.select(*by, *kept, F.col(p).alias("p"), y.cast("double").alias("y"))
    if not by:
        src = src.withColumn("__all", F.lit(0))
    edges = equal_mass_edges(src, group, "p", n_bins, w).withColumnRenamed("n", "__t")
    t = attach_bins(src, edges, group, "p").groupBy(*group, "bin").agg(
        F.max("__t").alias("__t"), n_rows(w).alias("n"), mean(F.col("p"), w).alias("p_mean"),
        mean(F.col("y"), w).alias("y_mean"))
    return t.withColumn("weight", F.col("n") / F.col("__t")).select(*by, "bin", "n", "p_mean", "y_mean", "weight")


def calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ECE and largest bin gap from a reliability table."""
    gap = F.abs(F.col("p_mean") - F.col("y_mean"))
    return table.groupBy(*by).agg(F.sum(F.col("weight") * gap).alias("ece"),
                                  F.max(gap).alias("max_ce"))


def class_rows(df: DataFrame, probs: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, class): class index, its probability, one-vs-rest label."""
    return df.select(*keep, F.col(y).alias("__y"), F.posexplode(probs).alias("cls", "p")).select(
        *keep, "cls", "p", F.when(F.col("cls") == F.col("__y"), 1.0).otherwise(0.0).alias("hit"))


def class_calibration(df: DataFrame, probs: str, y: str, n_bins: int = 20,
                      by: Sequence[str] = (), w: str | None = None) -> DataFrame:
    """One-vs-rest ECE per class (and per extra key)."""
    keys, kept = [*by, "cls"], [w] if w else []
    return calibration_error(reliability(class_rows(df, probs, y, [*by, *kept]), "p", "hit", keys, n_bins, w),
                             keys)


def forecast_calibration(df: DataFrame, columns: Sequence[str], y: str, k: int,
                         n_bins: int = 20, w: str | None = None) -> DataFrame:
    """(forecast, ece, max_ce) of several forecast columns in one set of passes.

    Two-class columns hold doubles; multi-class ones hold arrays, whose ECE is
    the mean over one-vs-rest classes and whose max is the worst class.
    """
    kept = [y, w] if w else [y]
    long = df.select(*kept, F.explode(F.array(*[F.struct(
        F.lit(c).alias("forecast"), F.col(c).alias("__f")) for c in columns])).alias("r")).select(*kept, "r.*")
    if k == 2:
        return calibration_error(reliability(long, "__f", y, ["forecast"], n_bins, w), ["forecast"])
    per = class_calibration(long, "__f", y, n_bins, ["forecast"], w)
    return per.groupBy("forecast").agg(F.avg("ece").alias("ece"), F.max("ece").alias("max_ce"))


def top_label(df: DataFrame, probs: str, y: str) -> DataFrame:
    """Confidence and correctness of the predicted class (first wins a tie)."""
    return df.withColumns({
        "conf": F.array_max(probs),
        "correct": F.when(arg_max(F.col(probs)) == F.col(y), 1.0).otherwise(0.0)})


def murphy(df: DataFrame, p: str, y: str, n_bins: int = 20) -> DataFrame:
    """One row: bs, bs_binned, rel, res, unc; bs_binned = rel - res + unc."""
    raw = df.agg(F.avg(brier_binary(F.col(p), F.col(y))).alias("bs"),
                 F.avg(F.col(y).cast("double")).alias("ybar"))
    t = reliability(df, p, y, n_bins=n_bins)
    bar = raw.select("ybar").scalar()
    gap = F.pow(F.col("p_mean") - F.col("y_mean"), 2)
    inner = F.col("y_mean") * (1 - F.col("y_mean"))
    agg = t.withColumn("__bar", bar).agg(
        F.sum(F.col("weight") * (gap + inner)).alias("bs_binned"),
        F.sum(F.col("weight") * gap).alias("rel"),
        F.sum(F.col("weight") * F.pow(F.col("y_mean") - F.col("__bar"), 2)).alias("res"),
        F.max("__bar").alias("__bar"))
    return agg.select(raw.select("bs").scalar().alias("bs"), "bs_binned", "rel", "res",
                      (F.col("__bar") * (1 - F.col("__bar"))).alias("unc"),
                      F.lit(n_bins).alias("n_bins"))


def adaptive_bins(max_bins: int = 20, min_bins: int = 2, per_bin: int = 500) -> Column:
    """Bin count that grows with the group size ``n``."""
    return F.least(F.lit(max_bins), F.greatest(F.lit(min_bins), F.floor(F.col("n") / per_bin)))


# ---- cuts of scored rows -----------------------------------------------------

def forecast_rows(df: DataFrame, forecasts: Sequence[str], y: str, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, forecast): both losses, and the probability and label that reliability compares.

    For two classes those are the forecast and the label itself, for more the
    largest probability and whether its class came true.
    """
    def look(c: str) -> Column:
        p, yy = F.col(c), F.col(y)
        if k == 2:
            losses, seen = (nll_binary(p, yy, EPS_BOARD), brier_binary(p, yy)), (p, yy.cast("double"))
        else:
            losses = nll_multi(p, yy, EPS_BOARD), brier_multi(p, yy, k)
            seen = F.array_max(p), F.when(arg_max(p) == yy, 1.0).otherwise(0.0)
        return F.struct(F.lit(c).alias("forecast"), *[
            e.alias(n) for n, e in zip(("nll", "brier", "p", "hit"), (*losses, *seen))])

    return df.select(*keep, F.explode(F.array(*[look(c) for c in forecasts])).alias("__r")).select(*keep, "__r.*")


def breakdown(df: DataFrame, forecasts: Sequence[str], y: str, k: int, facets: Mapping[str, Column],
              by: Sequence[str] = (), w: str | None = None) -> DataFrame:
    """(by.., forecast, facet, name, n, nll, brier, p_mean, y_mean): every cut of every forecast.

    A facet is an array of the names that a row belongs to; names may overlap, a
    null array belongs nowhere.  Rows are expanded once and summed before the
    only shuffle, which moves one row per task and cell.
    """
    def cuts(facet: str, names: Column) -> Column:
        own = F.coalesce(names, F.array().cast("array<string>"))
        return F.transform(own, lambda n: F.struct(F.lit(facet).alias("facet"), n.alias("name")))

    src = df.withColumn("__cuts", F.flatten(F.array(*[cuts(f, names) for f, names in facets.items()])))
    kept = [*by, "__cuts", w] if w else [*by, "__cuts"]
    long = forecast_rows(src, forecasts, y, k, kept).select("*", F.explode("__cuts").alias("__c"))
    keys = [*by, "forecast", "facet", "name"]
    return long.select("*", "__c.*").groupBy(*keys).agg(n_rows(w).alias("n"), *[
        mean(F.col(c), w).alias(n) for c, n in (("nll", "nll"), ("brier", "brier"), ("p", "p_mean"), ("hit", "y_mean"))])


def forecast_reliability(df: DataFrame, forecasts: Sequence[str], y: str, k: int, by: Sequence[str] = (),
                         n_bins: int | Column = 20, w: str | None = None) -> DataFrame:
    """The reliability tables of several forecasts from one set of passes."""
    kept = [*by, w] if w else by
    return reliability(forecast_rows(df, forecasts, y, k, kept), "p", "hit", [*by, "forecast"], n_bins, w)


def facet_calibration(df: DataFrame, forecasts: Sequence[str], y: str, k: int, names: Column,
                      by: Sequence[str] = (), w: str | None = None) -> DataFrame:
    """(by.., forecast, name, ece, max_ce) per overlapping bucket, with bins that grow with its rows.

    Edges take several passes, so the few columns that they need are stored before.
    """
    needed = pin(df.select(*by, *([w] if w else []), *forecasts, y, names.alias("__names")))
    each = needed.withColumn("name", F.explode("__names")).drop("__names")
    keys = [*by, "name", "forecast"]
    return calibration_error(forecast_reliability(each, forecasts, y, k, [*by, "name"], adaptive_bins(), w), keys)


# Names of the wickets bands in the calibration table.
BAND_NAMES = ("0-1", "2-3", "4-5", "6+")


def match_buckets(phase_edges: Sequence[int], wicket_edges: Sequence[int] = (2, 4, 6)) -> Column:
    """Overlapping bucket names of a row: innings x phase, wickets band, last 30 balls."""
    inn = F.when(F.col("is_chase") >= 1.0, "2").otherwise("1")
    phase = (band_right(F.col("legal_balls"), phase_edges) + 1).cast("string")
    band = F.array(*[F.lit(b) for b in BAND_NAMES])[band_right(F.col("wickets"), wicket_edges)]
    return F.array_compact(F.array(
        F.concat(F.lit("innings"), inn, F.lit("/phase"), phase),
        F.concat(F.lit("wickets "), band),
        F.when(F.col("balls_remaining") <= 30, F.lit("last 30 balls"))))


def bucket_calibration(df: DataFrame, buckets: Column, p: str, y: str,
                       n_bins: int | Column | None = None) -> DataFrame:
    """Calibration per overlapping bucket; ``buckets`` is an array of names per row."""
    src = df.select(F.explode(buckets).alias("bucket"), F.col(p).alias("p"),
                    F.col(y).cast("double").alias("y"))
    means = src.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p_mean"),
                                      F.avg("y").alias("y_mean"))
    bins = adaptive_bins() if n_bins is None else n_bins
    e = calibration_error(reliability(src, "p", "y", ["bucket"], bins), ["bucket"])
    return means.join(F.broadcast(e), "bucket")
