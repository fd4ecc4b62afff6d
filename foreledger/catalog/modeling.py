"""Registered queries with no plain SQL twin: fitted models, calibration maps, whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreledger.catalog.base import (
    EV_ORDER, EVENT_CLASSES, EVENT_VALENCE, LI_KEY, LI_ORDER, SQL_EVENT_SCORED, SQL_LINES, SQL_SCORED, day_chunk, scored_events)
from foreledger.catalog.scoring import reliability_sql
from foreledger.catalog.splits import fact_view
from foreledger.catalog.tables import SQL as SQL_TABLES
from foreledger import functions as fn
from foreledger.operators import calibrate as C, features as FE, increments, metrics as M, models as MO, tables as T, tuning
from foreledger.plans import increment, leaderboard
from foreledger.sources.stored import stored

K = len(EVENT_CLASSES)
NUMERIC = list(FE.FEATURE_COLUMNS)
# A line is dear above this price: the features tell its quantity, not its unit price.
DEAR = 35_000


def _assembled(spark, sf):
    """Binary rows over every line: the feature matrix, y = dear, split and key columns."""
    f = fact_view(spark, sf).withColumn("y", F.when(F.col("l_extendedprice") > DEAR, 1).otherwise(0))
    keep = ["match_id", "y", "temporal_split", "start_date", "l_extendedprice", *LI_KEY]
    return stored(FE.build_features(f, keep))


def _parts(df):
    return [df.filter(F.col("temporal_split") == s) for s in ("train", "val", "test")]


def _scored(spark, sf):
    from foreledger.catalog.base import scored_lines

    return _parts(stored(scored_lines(spark, sf).select("p", "y", "temporal_split")))


def c2_platt(spark, sf):
    """Raw NLL on test, and the slopes of the val NLL in both parameters: zero at the fit."""
    _, val, test = _scored(spark, sf)
    m = C.fit_platt(val, "p", "y")
    off = m.apply(F.col("p")) - F.col("y")
    at = val.agg(F.round(F.avg(off * fn.logit(F.col("p"))), 5).alias("slope_a"), F.round(F.avg(off), 5).alias("slope_b"))
    raw = M.mean_losses(test, {"raw": M.nll_binary(F.col("p"), F.col("y"))})
    return raw.withColumns({c: F.abs(at.select(c).scalar()) for c in ("slope_a", "slope_b")})


def c3_isotonic(spark, sf):
    """Raw Brier score on test, blocks of the val fit that are not at their mean, and whether the map rises to its end."""
    _, val, test = _scored(spark, sf)
    apply, _ = C.fit_isotonic(val, "p", "y")
    s = apply(val, "p", "c").groupBy("p").agg(F.first("c").alias("c"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    block = s.groupBy(F.round("c", 9).alias("level")).agg(
        F.sum("n").alias("n"), F.min("p").alias("first_p"), F.max("p").alias("last_p"),
        F.round(F.sum("y") / F.sum("n"), 9).alias("mean_y"))
    bad = block.filter(F.abs(F.col("level") - F.col("mean_y")) > 1e-8)
    falls = s.agg(F.max(F.struct("c", "p")).alias("top"), F.max(F.struct("p", "c")).alias("last"))
    return M.mean_losses(test, {"raw": M.brier_binary(F.col("p"), F.col("y"))}).withColumns({
        "blocks_off": bad.agg(F.count(F.lit(1))).scalar(),
        "top_is_last": falls.select((F.col("top.c") == F.col("last.c")).cast("long")).scalar()})


def c3_isotonic_map(spark, sf):
    """The fitted value of every distinct val score, and whether many small ranges give the same pools."""
    _, val, _ = _scored(spark, sf)
    apply, pools = C.fit_isotonic(val, "p", "y")
    small = C.isotonic_blocks(val.groupBy(F.col("p").alias("x")).agg(F.sum("y").alias("s"), F.count("*").alias("w")), 256)
    pool = ["lo", "hi", F.round("value", 9)]
    apart = pools.select(*pool).exceptAll(small.select(*pool)).count() + small.select(*pool).exceptAll(pools.select(*pool)).count()
    return apply(val.select("p").distinct(), "p", "c").select(
        "p", F.round("c", 8).alias("c"), F.lit(apart).cast("long").alias("pools_apart"))


def c4_alternate_nll(spark, sf):
    """Both calibrated columns side by side, each scored on test."""
    _, val, test = _scored(spark, sf)
    apply, _ = C.fit_isotonic(val, "p", "y")
    s = apply(test.withColumn("a", C.fit_platt(val, "p", "y").apply(F.col("p"))), "p", "c")
    return M.mean_losses(s, {"platt": M.nll_binary(F.col("a"), F.col("y")), "isotonic": M.nll_binary(F.col("c"), F.col("y"))})


def c5_augment_then_calibrate(spark, sf):
    """Base NLL on test, and whether the augmented val NLL is least at the fitted temperature."""
    ev = scored_events(spark, sf).withColumnRenamed("p", "base")
    train, val, test = _parts(ev.select("event_id", "user_id", "y", "base", "temporal_split"))
    t = C.fit_temperature(increment.augmented(val, train, 400.0, K, ["user_id"]), "q", "y")
    s = increment.augmented(val, train, 400.0, K, ["user_id"])
    nll = lambda f: F.avg(tuning.nll_of_logits(fn.log_floor(F.col("q")), F.col("y"), t * f))
    at = s.agg(nll(1.0).alias("at"), nll(max(0.99, C.T_BOUNDS[0] / t)).alias("below"), nll(min(1.01, C.T_BOUNDS[1] / t)).alias("above"))
    best = at.select(((F.col("at") <= F.col("below")) & (F.col("at") <= F.col("above"))).cast("long")).scalar()
    return M.mean_losses(test, {"base": M.nll_multi(F.col("base"), F.col("y"))}).withColumn("is_least", best)


def l1_marginal(spark, sf):
    train, val, _ = _parts(_assembled(spark, sf))
    m = MO.fit_marginal(train, "y", 2, order=LI_ORDER)
    return M.mean_losses(m.predict(val, "p"), {"nll": M.nll_binary(F.col("p"), F.col("y"))})


def l2_class_table(spark, sf):
    a = _assembled(spark, sf).withColumn("y", F.col("y") + F.when(F.col("gender_female") == 1, 0).otherwise(1))
    train, val, test = _parts(a)
    m = MO.fit_table_multi(train, val, "y", 3, "t20")
    s = m.predict(test, "p")
    return M.mean_losses(s, {"nll": M.nll_multi(F.col("p"), F.col("y"))}).withColumn("tau", F.lit(m.tuned["tau"]))


def l3_monotone_table(spark, sf):
    train, val, _ = _parts(_assembled(spark, sf))
    m = MO.fit_table_binary(train, val, "y", "t20")
    return m.parts["cells"]


def l4_pava(spark, sf):
    """Smoothed lattices of the return rate over innings, phase, wickets and rate bands."""
    train = _parts(_assembled(spark, sf))[0]
    banded = T.bucket_axes(train, "t20")
    lv = T.shrunk_levels(T.rollup_totals(banded, list(T.TABLE_AXES), {"y": F.col("y")}), list(T.TABLE_AXES), ["y"], 50.0)
    grid = T.lattice_counts(banded, T.LATTICE)
    return MO.smooth_lattices(T.prefix_lookup(grid, lv, list(T.TABLE_AXES), ["y"]))


def l5_monotonicity(spark, sf):
    """Violations left in the smoothed lattices (the count must be zero)."""
    return MO.monotonicity_violations(l4_pava(spark, sf)).agg(F.count(F.lit(1)).alias("n_violations"))


def l5_violations(spark, sf):
    """Steps the wrong way in a lattice of counts that nothing has smoothed."""
    from foreledger.catalog.tables import a27_lattice_counts

    cells = a27_lattice_counts(spark, sf).select(
        F.col("st").cast("int").alias("innings"), F.lit(0).alias("phase"), F.col("qb").cast("int").alias("wkts"),
        F.col("db").cast("int").alias("rate"), F.col("n").cast("double").alias("p"))
    return MO.monotonicity_violations(cells).select("axis", "innings", "wkts", "rate", "step")


def l6_logistic(spark, sf):
    """Mean forecast on train, which the unpenalised intercept sets to the class share, and the test score beside the marginal's."""
    train, val, test = _parts(_assembled(spark, sf))
    m = MO.fit_logistic(train, val, "y", 2, NUMERIC)
    share = m.predict(train, "p").agg(F.round(F.avg("p"), 4)).scalar()
    return _beside_marginal(m, train, test).withColumns({
        "mean_p": share, "c_in_grid": F.lit(int(m.tuned["c"] in MO.C_GRID)).cast("long")})


def _beside_marginal(m, train, test):
    """Rows of test, and whether a model's NLL on them is no worse than the constant train share's, within 0.02."""
    share = F.lit(train.agg(F.avg("y")).first()[0])
    s = M.mean_losses(m.predict(test, "p"), {
        "nll": M.nll_binary(F.col("p"), F.col("y")), "flat": M.nll_binary(share, F.col("y"))})
    return s.select("n", F.round("flat", 9).alias("flat"), (F.col("nll") <= F.col("flat") + 0.02).cast("long").alias("no_worse"))


def l7_gbt(spark, sf):
    """Full schedule: the round kept is on the step grid, and the test score beside the marginal's."""
    train, val, test = _parts(_assembled(spark, sf))
    m = MO.fit_boosted(train, val, "y", 2, NUMERIC)
    on_grid = m.tuned["n_iter"] % MO.STEP == 0 and MO.STEP <= m.tuned["n_iter"] <= MO.MAX_ROUNDS
    return _beside_marginal(m, train, test).withColumn("on_grid", F.lit(int(on_grid)).cast("long"))


def l16_run_cell(spark, sf):
    """A whole two-class leaderboard cell: four models, calibration, intervals, skill.

    Every row of the board, whether its interval holds its value, and whether the marginal's skill is 0.
    """
    train, val, test = _parts(_assembled(spark, sf))
    b = leaderboard.run_cell(train, val, test, k=2, features=NUMERIC, fmt="t20", order=LI_ORDER).board
    held = F.coalesce((F.col("lo") <= F.col("value")) & (F.col("value") <= F.col("hi")), F.lit(True))
    return b.select("model", "split", "metric", held.cast("long").alias("in_order"),
                    F.when(F.col("model") == leaderboard.LADDER[0], F.round("skill", 9)).alias("marginal_skill"))


def l16_outcome_cell(spark, sf):
    """An eleven-class cell of the three quick models: rows of test by year and by bucket for each."""
    a = _assembled(spark, sf).withColumn("y", F.least(F.floor(F.col("l_extendedprice") / 10_000), F.lit(10)).cast("int"))
    train, val, test = _parts(a)
    done = leaderboard.run_cells(
        {("t1", "t20"): {"train": train, "val": val, "test": test, "k": 11}}, features=NUMERIC, order=LI_ORDER,
        names=leaderboard.LADDER[:3], date="start_date", buckets=M.match_buckets(T.PHASE_EDGES["t20"]))
    known = done["cuts"].filter(F.col("nll").isNotNull() & (F.col("p_mean").between(0, 1)))
    return known.select("task", "fmt", "model", "facet", "name", "n", F.round("y_mean", 9).alias("y_mean")).withColumn(
        "y_mean", F.when(F.col("model") == leaderboard.LADDER[0], F.col("y_mean")))


def _cell_rows(spark, sf):
    from foreledger.catalog.base import scored_lines

    return scored_lines(spark, sf).withColumns({
        "years": F.array(F.year("start_date").cast("string")),
        "buckets": F.array_compact(F.array(
            F.concat(F.lit("status "), "l_linestatus"), F.when(F.col("l_discount") > 0.08, F.lit("deep discount"))))})


def m12_breakdown(spark, sf):
    """Both forecasts by split, cut by year and by overlapping bucket, from one aggregate."""
    t = M.breakdown(_cell_rows(spark, sf), ["p", "p0"], "y", 2, {
        "all": F.array(F.lit("all")), "year": F.col("years"), "bucket": F.col("buckets")}, ["temporal_split"])
    return t.select("temporal_split", "forecast", "facet", "name", "n", *[
        F.round(c, 9).alias(c) for c in ("nll", "brier", "p_mean", "y_mean")])


def m12_bucket_calibration(spark, sf):
    """Calibration error of both forecasts per split and bucket."""
    t = M.facet_calibration(_cell_rows(spark, sf), ["p", "p0"], "y", 2, F.col("buckets"), ["temporal_split"])
    return t.select("temporal_split", "forecast", "name", *[F.round(c, 9).alias(c) for c in ("ece", "max_ce")])


def m12_reliability(spark, sf):
    """Top-label reliability of the five-class forecast and of the marginal, per split."""
    t = M.forecast_reliability(scored_events(spark, sf), ["p", "p0"], "y", K, ["temporal_split"])
    return t.select("temporal_split", "forecast", F.col("bin").cast("long").alias("bin"), "n", *[
        F.round(c, 9).alias(c) for c in ("p_mean", "y_mean", "weight")])


def r6_identity_gate(spark, sf):
    ev = scored_events(spark, sf).withColumnRenamed("p", "base").select(
        "event_id", "user_id", F.hour("ts").alias("hour"), "y", "base", "temporal_split")
    train, val, test = _parts(stored(ev))
    g = increment.identity_gate(train, val, test, k=K, entities=["user_id", "hour"], key=["event_id"], group="user_id")
    return g["verdict"].select("metric", "point", "lo", "hi", "rel_pct", "bits", "verdict")


def l15_tuned_kappa(spark, sf):
    """Every strength, and whether its NLL at the fitted temperature is no higher than at one."""
    ev = scored_events(spark, sf).withColumnRenamed("p", "base").filter("temporal_split = 'val'").select(
        "event_id", "user_id", "ts", "y", "base")
    c = increment.tune_kappa(ev, K, EVENT_VALENCE, 2.4, 4.2, ["user_id"], EV_ORDER, chunk=day_chunk())
    plain = tuning.kappa_curve(ev.withColumn("s", increments.residual_signal(F.col("base"), F.col("y"), EVENT_VALENCE)),
                               "base", "y", "s", ["user_id"], EV_ORDER, EVENT_VALENCE, F.lit(2.4), F.lit(4.2),
                               increments.KAPPA_GRID, day_chunk()).withColumnRenamed("nll", "at_one")
    return c.join(plain, "param").select(
        F.col("param").alias("kappa"), F.round("at_one", 8).alias("nll_at_one"),
        (F.col("nll") <= F.col("at_one") + 1e-12).cast("long").alias("no_worse"))


def g1_logistic_canary(spark, sf):
    train, val, _ = _parts(_assembled(spark, sf))
    b0 = MO.fit_marginal(train, "y", 2, order=LI_ORDER)
    base = MO.mean_nll(b0.predict(val, "p"), "p", "y", 2)
    c = MO.fit_logistic(train, val, "y", 2, NUMERIC).tuned["c"]
    s = leaderboard.shuffled_target(train, val, base, k=2, features=NUMERIC, c=c, key=LI_KEY)
    return s.select(F.round("nll_base", 9).alias("nll_base"), F.col("passed").cast("long").alias("passed"), F.col("leaks").cast("long").alias("leaks"))


QUERIES = {f.__name__: f for f in (
    c2_platt, c3_isotonic, c3_isotonic_map, c4_alternate_nll, c5_augment_then_calibrate, l1_marginal, l2_class_table, l3_monotone_table,
    l4_pava, l5_monotonicity, l5_violations, l6_logistic, l7_gbt, l16_run_cell, l16_outcome_cell, m12_breakdown,
    m12_bucket_calibration, m12_reliability, r6_identity_gate, l15_tuned_kappa, g1_logistic_canary)}
_CELL_SQL = SQL_SCORED + """,
cut AS (SELECT *, list_filter(['status ' || l_linestatus, CASE WHEN l_discount > 0.08 THEN 'deep discount' END], lambda x: x IS NOT NULL) AS bs
  FROM scored),
two AS (SELECT temporal_split, 'p' AS forecast, p, y, start_date, bs FROM cut UNION ALL
  SELECT temporal_split, 'p0', p0, y, start_date, bs FROM cut),
faced AS (SELECT *, 'all' AS facet, 'all' AS name FROM two
  UNION ALL SELECT *, 'year', year(start_date)::VARCHAR FROM two UNION ALL SELECT *, 'bucket', unnest(bs) FROM two)"""
_TOP_SQL = SQL_EVENT_SCORED + """,
tops AS (SELECT temporal_split || '|' || forecast AS g, list_max(p) AS p, (list_position(p, list_max(p)) - 1 = y)::INT AS y
  FROM (SELECT temporal_split, 'p' AS forecast, p, y FROM escored UNION ALL SELECT temporal_split, 'p0', p0, y FROM escored))"""
_DEAR_SQL = f"""a AS (SELECT *, (l_extendedprice > {DEAR})::INT AS y FROM lines),
      s AS (SELECT avg(y) AS share FROM a WHERE temporal_split = 'train')"""
SQL = {
    "l5_monotonicity": "SELECT 0::BIGINT AS n_violations",
    "l5_violations": f"""WITH cells AS (SELECT st::INT AS innings, qb::INT AS wkts, db::INT AS rate, n::DOUBLE AS p
        FROM ({SQL_TABLES["a27_lattice_counts"]})),
      s AS (SELECT *, p - lag(p) OVER (PARTITION BY innings, wkts ORDER BY rate) AS r,
        p - lag(p) OVER (PARTITION BY innings, rate ORDER BY wkts) AS w FROM cells)
      SELECT 'rate' AS axis, innings, wkts, rate, r AS step FROM s WHERE r < -1e-9
      UNION ALL SELECT 'wickets', innings, wkts, rate, w FROM s WHERE CASE WHEN innings = 0 THEN w > 1e-9 ELSE w < -1e-9 END""",
    "c2_platt": f"""WITH {SQL_SCORED} SELECT count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS raw, 0.0 AS slope_a,
        0.0 AS slope_b FROM scored WHERE temporal_split = 'test'""",
    "c3_isotonic": f"""WITH {SQL_SCORED} SELECT count(*) AS n, avg((p - y) * (p - y)) AS raw, 0::BIGINT AS blocks_off, 1::BIGINT AS top_is_last
      FROM scored WHERE temporal_split = 'test'""",
    "c3_isotonic_map": f"""WITH {SQL_SCORED}, d AS (SELECT p, sum(y) AS s, count(*) AS w, row_number() OVER (ORDER BY p) AS i
        FROM scored WHERE temporal_split = 'val' GROUP BY p),
      cum AS (SELECT *, sum(s) OVER (ORDER BY i) AS ts, sum(w) OVER (ORDER BY i) AS tw FROM d),
      span AS (SELECT a.i AS a, b.i AS b, (b.ts - a.ts + a.s) / (b.tw - a.tw + a.w) AS m FROM cum a JOIN cum b ON b.i >= a.i),
      least_after AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM span)
      SELECT p, round(least(greatest(max(m), {fn.EPS}), 1 - {fn.EPS}), 8) AS c, 0::BIGINT AS pools_apart
      FROM least_after JOIN d USING (i) GROUP BY p""",
    "c5_augment_then_calibrate": f"""WITH {SQL_EVENT_SCORED} SELECT count(*) AS n, avg(-ln(p[y + 1])) AS base, 1::BIGINT AS is_least
      FROM escored WHERE temporal_split = 'test'""",
    "l15_tuned_kappa": f"""WITH {SQL_EVENT_SCORED}, v AS (SELECT [1.0, 0.0, 6.0, 2.0, 3.0] AS v),
      res AS (SELECT event_id, user_id, ts, y, p, v, v[y + 1] - list_sum(list_transform(range(5), lambda i: p[i + 1] * v[i + 1])) AS s
        FROM escored, v WHERE temporal_split = 'val'),
      sm AS (SELECT y, p, v, coalesce(sum(s) OVER w, 0) AS sb, count(*) OVER w AS nb FROM res
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      kp AS (SELECT unnest([2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 600.0])::DOUBLE AS kappa),
      z AS (SELECT kappa, y, list_transform(range(5), lambda i: exp(ln(p[i + 1]) + sb / (nb + kappa) * (v[i + 1] - 2.4) / 4.2)) AS z FROM sm, kp)
      SELECT kappa, round(avg(ln(list_sum(z)) - ln(z[y + 1])), 8) AS nll_at_one, 1::BIGINT AS no_worse FROM z GROUP BY kappa""",
    "l6_logistic": f"""WITH {SQL_LINES}, {_DEAR_SQL} SELECT count(*) AS n, round(avg(-(y * ln(share) + (1 - y) * ln(1 - share))), 9) AS flat,
      1::BIGINT AS no_worse, round(any_value(share), 4) AS mean_p, 1::BIGINT AS c_in_grid FROM a, s WHERE temporal_split = 'test'""",
    "l7_gbt": f"""WITH {SQL_LINES}, {_DEAR_SQL} SELECT count(*) AS n, round(avg(-(y * ln(share) + (1 - y) * ln(1 - share))), 9) AS flat,
      1::BIGINT AS no_worse, 1::BIGINT AS on_grid FROM a, s WHERE temporal_split = 'test'""",
    "l16_run_cell": """SELECT model, split, metric, 1::BIGINT AS in_order,
        CASE WHEN model = 'B0_marginal' AND metric IN ('nll', 'brier') THEN 0.0::DOUBLE END AS marginal_skill
      FROM (SELECT unnest(['B0_marginal', 'B1_table', 'B2_logistic', 'B3_gbm']) AS model),
        (SELECT unnest(['val', 'test', 'val', 'test', 'val', 'test', 'val', 'test', 'test']) AS split,
          unnest(['nll', 'nll', 'brier', 'brier', 'ece', 'ece', 'max_ce', 'max_ce', 'alternate_nll']) AS metric)""",
    "l16_outcome_cell": f"""WITH {SQL_LINES}, t AS (SELECT *, least(floor(l_extendedprice / 10000), 10)::INT AS y,
        l_linestatus = 'O' AND l_returnflag <> 'A' AS second, least(floor(l_quantity * 2.3), 120)::INT AS balls FROM lines),
      top AS (SELECT y FROM t WHERE temporal_split = 'train' GROUP BY y ORDER BY count(*) DESC, y LIMIT 1),
      x AS (SELECT t.y = top.y AS hit, start_date, second, balls, l_linenumber + 1 AS w FROM t, top WHERE temporal_split = 'test'),
      f AS (SELECT hit, 'year' AS facet, year(start_date)::VARCHAR AS name FROM x
        UNION ALL SELECT hit, 'bucket', 'innings' || (1 + second::INT) || '/phase'
          || (1 + (balls >= 36)::INT + (balls >= 72)::INT + (balls >= 96)::INT) FROM x
        UNION ALL SELECT hit, 'bucket', 'wickets ' || ['0-1', '2-3', '4-5', '6+'][1 + (w >= 2)::INT + (w >= 4)::INT + (w >= 6)::INT] FROM x
        UNION ALL SELECT hit, 'bucket', 'last 30 balls' FROM x WHERE 120 - balls <= 30)
      SELECT 't1' AS task, 't20' AS fmt, model, facet, name, count(*) AS n,
        CASE WHEN model = 'B0_marginal' THEN round(avg(hit::INT), 9) END AS y_mean
      FROM f, (SELECT unnest(['B0_marginal', 'B1_table', 'B2_logistic']) AS model) GROUP BY model, facet, name""",
    "m12_breakdown": f"""WITH {_CELL_SQL} SELECT temporal_split, forecast, facet, name, count(*) AS n,
      round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS nll, round(avg((p - y) * (p - y)), 9) AS brier,
      round(avg(p), 9) AS p_mean, round(avg(y), 9) AS y_mean FROM faced GROUP BY ALL""",
    "m12_bucket_calibration": f"""WITH {_CELL_SQL}, bk AS (SELECT temporal_split || '|' || forecast || '|' || name AS g, p, y
        FROM faced WHERE facet = 'bucket'), {reliability_sql("bk", "g", "least(20, greatest(2, n // 500))")}
      SELECT split_part(g, '|', 1) AS temporal_split, split_part(g, '|', 2) AS forecast, split_part(g, '|', 3) AS name,
        round(sum(weight * abs(p_mean - y_mean)), 9) AS ece, round(max(abs(p_mean - y_mean)), 9) AS max_ce FROM rel GROUP BY g""",
    "m12_reliability": f"""WITH {_TOP_SQL}, {reliability_sql("tops", "g")}
      SELECT split_part(g, '|', 1) AS temporal_split, split_part(g, '|', 2) AS forecast, bin, n, round(p_mean, 9) AS p_mean,
        round(y_mean, 9) AS y_mean, round(weight, 9) AS weight FROM rel""",
    "g1_logistic_canary": f"""WITH {SQL_LINES}, a AS (SELECT *, (l_extendedprice > {DEAR})::INT AS y FROM lines),
      b AS (SELECT avg(y0) AS p FROM (SELECT arg_min(y, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS y0 FROM a
        WHERE temporal_split = 'train' GROUP BY l_orderkey))
      SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS nll_base, 1::BIGINT AS passed, 0::BIGINT AS leaks
      FROM a, b WHERE temporal_split = 'val'""",
    "l1_marginal": f"""WITH {SQL_LINES}, a AS (SELECT *, (l_extendedprice > {DEAR})::INT AS y FROM lines),
      b AS (SELECT avg(y0) AS p FROM (SELECT arg_min(y, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS y0 FROM a
        WHERE temporal_split = 'train' GROUP BY l_orderkey))
      SELECT count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS nll FROM a, b WHERE temporal_split = 'val'""",
}
