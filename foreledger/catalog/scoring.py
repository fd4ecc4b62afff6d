"""Registered queries: proper scores, equal-mass calibration, tables by bucket and year."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreledger.catalog.base import (
    EVENT_CLASSES, SQL_EVENT_SCORED, SQL_SCORED, scored_events, scored_lines)
from foreledger.functions import arg_max
from foreledger.operators import metrics as M

from foreledger.sources.stored import stored

K = len(EVENT_CLASSES)
R = 9


def _lines(spark, sf, *cols):
    """Scored lines, written once: calibration reads them several times."""
    return stored(scored_lines(spark, sf).select(*cols, "p", "y"))


def _events(spark, sf):
    return stored(scored_events(spark, sf).select("p", "y"))


def _r(df, *keep):
    """Round every double so engines agree past summation order."""
    return df.select(*[F.round(c, R).alias(c) if t == "double" and c not in keep else F.col(c)
                       for c, t in df.dtypes])


def w6_equal_mass_bins(spark, sf):
    t = M.reliability(_lines(spark, sf), "p", "y")
    return t.select(F.col("bin").cast("long").alias("bin"), "n", F.round("p_mean", R).alias("p_mean"))


def m1_nll_multi(spark, sf):
    s = scored_events(spark, sf)
    return _r(M.mean_losses(s, {"nll": M.nll_multi(F.col("p"), F.col("y")),
                                "nll0": M.nll_multi(F.col("p0"), F.col("y"))}, ["temporal_split"]))


def m2_nll_binary(spark, sf):
    s = scored_lines(spark, sf)
    return _r(M.mean_losses(s, {"nll": M.nll_binary(F.col("p"), F.col("y"))}, ["temporal_split"]))


def m3_brier_multi(spark, sf):
    s = scored_events(spark, sf)
    return _r(M.mean_losses(s, {"brier": M.brier_multi(F.col("p"), F.col("y"), K)}, ["temporal_split"]))


def m4_brier_binary(spark, sf):
    s = scored_lines(spark, sf)
    return _r(M.mean_losses(s, {"brier": M.brier_binary(F.col("p"), F.col("y"))}, ["temporal_split"]))


def m5_reliability(spark, sf):
    t = M.reliability(_lines(spark, sf, "temporal_split"), "p", "y", ["temporal_split"])
    return _r(t.withColumn("bin", F.col("bin").cast("long")))


def m6_ece(spark, sf):
    t = M.reliability(_lines(spark, sf, "temporal_split"), "p", "y", ["temporal_split"])
    return _r(M.calibration_error(t, ["temporal_split"]))


def m7_class_ece(spark, sf):
    c = M.class_calibration(_events(spark, sf), "p", "y")
    return _r(c.withColumn("cls", F.col("cls").cast("long")))


def m8_murphy(spark, sf):
    m = M.murphy(_lines(spark, sf), "p", "y")
    return _r(m.withColumn("n_bins", F.col("n_bins").cast("long")))


def m9_skill(spark, sf):
    s = scored_lines(spark, sf)
    m = M.mean_losses(s, {"a": M.brier_binary(F.col("p"), F.col("y")),
                          "b": M.brier_binary(F.col("p0"), F.col("y"))}, ["temporal_split"])
    return _r(m.select("temporal_split", M.skill(F.col("a"), F.col("b")).alias("skill")))


def m10_top_label(spark, sf):
    t = M.reliability(M.top_label(_events(spark, sf), "p", "y"), "conf", "correct")
    return _r(t.withColumn("bin", F.col("bin").cast("long")))


def m11_ece_adaptive(spark, sf):
    s = _lines(spark, sf, "l_linestatus")
    t = M.reliability(s, "p", "y", ["l_linestatus"], M.adaptive_bins(per_bin=1500))
    return _r(M.calibration_error(t, ["l_linestatus"]))


def o5_arg_max(spark, sf):
    s = scored_events(spark, sf)
    return s.groupBy(arg_max(F.col("p")).cast("long").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _buckets():
    q = F.col("l_quantity")
    return F.array_compact(F.array(
        F.concat(F.lit("status "), "l_linestatus"),
        F.when(q < 10, "quantity low").when(q < 30, "quantity mid").otherwise("quantity high"),
        F.when(F.col("l_discount") > 0.08, F.lit("deep discount"))))


def a17_bucket_calibration(spark, sf):
    return _r(M.bucket_calibration(
        _lines(spark, sf, "l_linestatus", "l_quantity", "l_discount"), _buckets(), "p", "y"))


def a18_by_year(spark, sf):
    t = M.loss_by_year(scored_lines(spark, sf), None, "l_orderkey", "start_date",
                       {"nll": M.nll_binary(F.col("p"), F.col("y"))})
    return _r(t.withColumn("year", F.col("year").cast("long")))


def j4_year_join(spark, sf):
    """The same slice with the date joined from the dimension."""
    from foreledger.catalog.base import table

    s = scored_lines(spark, sf).drop("start_date").withColumnRenamed("l_orderkey", "o_orderkey")
    d = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    t = M.loss_by_year(s, d, "o_orderkey", "d", {"brier": M.brier_binary(F.col("p"), F.col("y"))})
    return _r(t.withColumn("year", F.col("year").cast("long")))


QUERIES = {f.__name__: f for f in (
    w6_equal_mass_bins, m1_nll_multi, m2_nll_binary, m3_brier_multi, m4_brier_binary, m5_reliability,
    m6_ece, m7_class_ece, m8_murphy, m9_skill, m10_top_label, m11_ece_adaptive, o5_arg_max,
    a17_bucket_calibration, a18_by_year, j4_year_join)}


def reliability_sql(src: str, by: str, bins: str = "20") -> str:
    """CTEs ending in ``rel(by.., bin, n, p_mean, y_mean, weight)`` over (by, p, y) rows."""
    return f"""rs AS (SELECT {by} AS g, p, y::DOUBLE AS y FROM {src}),
srt AS (SELECT g, p, row_number() OVER (PARTITION BY g ORDER BY p) - 1 AS rk FROM rs),
sz AS (SELECT g, count(*) AS n, ({bins})::BIGINT AS b FROM (SELECT g, count(*) OVER (PARTITION BY g) AS n FROM rs)
  GROUP BY g, n),
hk AS (SELECT g, unnest(range(1, b)) AS k, n, b FROM sz),
h AS (SELECT g, k, (n - 1) * (k * (1.0::DOUBLE / b)) AS h FROM hk),
ed AS (SELECT h.g, k, lo.p AS lo, hi.p AS hi, h - floor(h) AS t FROM h
  JOIN srt lo ON lo.g = h.g AND lo.rk = floor(h)::BIGINT JOIN srt hi ON hi.g = h.g AND hi.rk = ceil(h)::BIGINT),
eds AS (SELECT g, list(CASE WHEN t < 0.5 THEN lo + (hi - lo) * t ELSE hi - (hi - lo) * (1 - t) END ORDER BY k) AS e
  FROM ed GROUP BY g),
bn AS (SELECT rs.*, len(list_filter(e, lambda x: x <= p))::BIGINT AS bin FROM rs JOIN eds USING (g)),
rel AS (SELECT g, bin, count(*) AS n, avg(p) AS p_mean, avg(y) AS y_mean,
  count(*) / (sum(count(*)) OVER (PARTITION BY g))::DOUBLE AS weight FROM bn GROUP BY g, bin)"""


def _rel(with_: str, src: str, by: str, select: str, bins: str = "20") -> str:
    return f"WITH {with_}, {reliability_sql(src, by, bins)} {select}"


_BIN_NLL = "-(y * ln(p) + (1 - y) * ln(1 - p))"
_CLS = SQL_EVENT_SCORED + """,
crow AS (SELECT k AS cls, p[k + 1] AS p, (y = k)::INT AS y FROM (SELECT y, p FROM escored), cls)"""
_TOP = SQL_EVENT_SCORED + """,
tops AS (SELECT list_max(p) AS p, (list_position(p, list_max(p)) - 1 = y)::INT AS y
  FROM (SELECT p, y FROM escored))"""
_ECE = "round(sum(weight * abs(p_mean - y_mean)), 9) AS ece, round(max(abs(p_mean - y_mean)), 9) AS max_ce"
_RELCOLS = "bin, n, round(p_mean, 9) AS p_mean, round(y_mean, 9) AS y_mean, round(weight, 9) AS weight"
_BK = SQL_SCORED + """,
bk AS (SELECT p, y, unnest(list_filter(['status ' || l_linestatus, CASE WHEN l_quantity < 10 THEN 'quantity low'
  WHEN l_quantity < 30 THEN 'quantity mid' ELSE 'quantity high' END,
  CASE WHEN l_discount > 0.08 THEN 'deep discount' END], lambda x: x IS NOT NULL)) AS bucket FROM scored)"""

SQL = {
    "w6_equal_mass_bins": _rel(SQL_SCORED, "scored", "0", "SELECT bin, n, round(p_mean, 9) AS p_mean FROM rel"),
    "m1_nll_multi": f"""WITH {SQL_EVENT_SCORED} SELECT temporal_split, count(*) AS n,
      round(avg(-ln(p[y + 1])), 9) AS nll, round(avg(-ln(p0[y + 1])), 9) AS nll0 FROM escored GROUP BY 1""",
    "m2_nll_binary": f"""WITH {SQL_SCORED} SELECT temporal_split, count(*) AS n,
      round(avg({_BIN_NLL}), 9) AS nll FROM scored GROUP BY 1""",
    "m3_brier_multi": f"""WITH {SQL_EVENT_SCORED} SELECT temporal_split, count(*) AS n,
      round(avg(list_sum(list_transform(range(5), lambda k: pow(p[k + 1] - (y = k)::INT, 2)))), 9) AS brier
      FROM escored GROUP BY 1""",
    "m4_brier_binary": f"""WITH {SQL_SCORED} SELECT temporal_split, count(*) AS n,
      round(avg(pow(p - y, 2)), 9) AS brier FROM scored GROUP BY 1""",
    "m5_reliability": _rel(SQL_SCORED, "scored", "temporal_split",
                           f"SELECT g AS temporal_split, {_RELCOLS} FROM rel"),
    "m6_ece": _rel(SQL_SCORED, "scored", "temporal_split",
                   f"SELECT g AS temporal_split, {_ECE} FROM rel GROUP BY g"),
    "m7_class_ece": _rel(_CLS, "crow", "cls", f"SELECT g AS cls, {_ECE} FROM rel GROUP BY g"),
    "m8_murphy": _rel(SQL_SCORED, "scored", "0", """SELECT
      (SELECT round(avg(pow(p - y, 2)), 9) FROM scored) AS bs,
      round(sum(weight * (pow(p_mean - y_mean, 2) + y_mean * (1 - y_mean))), 9) AS bs_binned,
      round(sum(weight * pow(p_mean - y_mean, 2)), 9) AS rel,
      round(sum(weight * pow(y_mean - yb, 2)), 9) AS res, round(max(yb * (1 - yb)), 9) AS unc,
      20::BIGINT AS n_bins FROM rel, (SELECT avg(y) AS yb FROM scored)"""),
    "m9_skill": f"""WITH {SQL_SCORED} SELECT temporal_split,
      round(1 - avg(pow(p - y, 2)) / avg(pow(p0 - y, 2)), 9) AS skill FROM scored GROUP BY 1""",
    "m10_top_label": _rel(_TOP, "tops", "0", f"SELECT {_RELCOLS} FROM rel"),
    "m11_ece_adaptive": _rel(SQL_SCORED, "scored", "l_linestatus",
                             f"SELECT g AS l_linestatus, {_ECE} FROM rel GROUP BY g",
                             "least(20, greatest(2, n // 1500))"),
    "o5_arg_max": f"""WITH {SQL_EVENT_SCORED} SELECT (list_position(p, list_max(p)) - 1)::BIGINT AS predicted,
      count(*) AS n FROM escored GROUP BY 1""",
    "a17_bucket_calibration": _rel(_BK, "bk", "bucket", """SELECT a.bucket, a.n, a.p_mean, a.y_mean, e.ece, e.max_ce FROM
      (SELECT bucket, count(*) AS n, round(avg(p), 9) AS p_mean, round(avg(y), 9) AS y_mean FROM bk GROUP BY 1) a
      JOIN (SELECT g, round(sum(weight * abs(p_mean - y_mean)), 9) AS ece,
        round(max(abs(p_mean - y_mean)), 9) AS max_ce FROM rel GROUP BY g) e ON g = bucket""",
                                  "least(20, greatest(2, n // 500))"),
    "a18_by_year": f"""WITH {SQL_SCORED} SELECT year(start_date) AS year, count(*) AS n,
      round(avg({_BIN_NLL}), 9) AS nll FROM scored GROUP BY 1""",
    "j4_year_join": f"""WITH {SQL_SCORED} SELECT year(start_date) AS year, count(*) AS n,
      round(avg(pow(p - y, 2)), 9) AS brier FROM scored GROUP BY 1""",
}
