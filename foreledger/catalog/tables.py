"""Registered queries: marginals, shrunken tables, effects, lookups, tilts, tuning curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreledger.catalog.base import (
    EV_ORDER, EVENT_CLASSES, EVENT_VALENCE, LI_KEY, LI_ORDER, SQL_EVENT_SCORED, SQL_EVENTS, SQL_LINES,
    day_chunk, event_marginal, event_split, lines_split, scored_events)
from foreledger.functions import band_right
from foreledger.operators import increments as I
from foreledger.operators import tables as T
from foreledger.operators import tuning

K = len(EVENT_CLASSES)
AXES = ["l_linestatus", "qb", "db"]


def _long(df, name):
    return df.select("*", F.posexplode(name).alias("k", "v")).drop(name)


def a12_laplace(spark, sf):
    m = T.laplace_marginal_long(event_split(spark, sf).filter("temporal_split = 'train'"), "y", K)
    return m.select(F.col("y").cast("long").alias("y"), F.round("p", 12).alias("p"))


def a13_group_rate(spark, sf):
    li = lines_split(spark, sf).filter("temporal_split = 'train'").withColumn(
        "y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    r = T.group_base_rate(li, ["l_orderkey"], "y", LI_ORDER)
    return r.select(F.round("base_rate", 12).alias("base_rate"), "n_groups")


def _banded(spark, sf):
    return lines_split(spark, sf).withColumns({
        "qb": band_right(F.col("l_quantity"), (10, 20, 30, 40)),
        "db": band_right(F.col("l_discount"), (0.035, 0.075)),
        "y": F.when(F.col("l_returnflag") == "R", 1).otherwise(0)})


def _axes(df):
    return df.withColumns({"l_linestatus": F.coalesce("l_linestatus", F.lit("*")),
                           "qb": F.coalesce(F.col("qb").cast("long"), F.lit(-1)),
                           "db": F.coalesce(F.col("db").cast("long"), F.lit(-1))})


def a14_rollup(spark, sf):
    t = T.rollup_totals(_banded(spark, sf).filter("temporal_split = 'train'"), AXES, {"y": F.col("y")})
    return _axes(t).select(*AXES, F.col("depth").cast("long").alias("depth"), "n", "y")


def a15_shrunk_table(spark, sf):
    t = T.shrunk_table(_banded(spark, sf).filter("temporal_split = 'train'"), AXES, {"y": F.col("y")}, 200.0)
    return _axes(t).select(*AXES, F.col("depth").cast("long").alias("depth"), "n",
                           F.round("e_y", 9).alias("e_y"))


def j7_prefix_fallback(spark, sf):
    """Table fitted on train; test rows fall back to the deepest known prefix."""
    b = _banded(spark, sf)
    train = b.filter("temporal_split = 'train'")
    lv = T.shrunk_levels(T.rollup_totals(train, AXES, {"y": F.col("y")}), AXES, ["y"], 50.0)
    r = T.prefix_lookup(b.filter("temporal_split = 'test'").select(*LI_KEY, *AXES), lv, AXES, ["y"])
    return r.groupBy(F.col("found_depth").cast("long").alias("found_depth")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("e_y"), 6).alias("sum_e"))


def a27_lattice_counts(spark, sf):
    b = _banded(spark, sf).withColumn(
        "st", F.when(F.col("l_linestatus") == "F", 0).otherwise(1))
    c = T.lattice_counts(b, {"st": 2, "qb": 5, "db": 3})
    return c.select(*[F.col(c_).cast("long").alias(c_) for c_ in ("st", "qb", "db", "n")])


def a16_entity_offsets(spark, sf):
    ev = event_split(spark, sf).filter("temporal_split = 'train'").withColumn(
        "who", F.when(F.col("value") > 2, F.col("user_id")))
    o = T.entity_offsets(ev, "who", "y", K, 25.0)
    return _long(o, "offset").select("who", "n", F.col("k").cast("long").alias("k"),
                                     F.round("v", 9).alias("v"))


def _supp_train(spark, sf):
    li = lines_split(spark, sf).withColumns({
        "y": F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2),
        "who": F.when(F.col("l_discount") > 0.005, F.col("l_partkey"))})
    return li, li.filter("temporal_split = 'train'")


def j5_effect_lookup(spark, sf):
    li, train = _supp_train(spark, sf)
    off = T.entity_offsets(train, "who", "y", 3, 10.0)
    r = T.attach_offsets(li.filter("temporal_split = 'test'"), off, "who", 3, "o")
    return r.groupBy("l_returnflag").agg(*[
        F.round(F.sum(F.col("o")[i]), 6).alias(f"o{i}") for i in range(3)])


def j6_seen_flag(spark, sf):
    li, train = _supp_train(spark, sf)
    r = T.attach_seen(li.filter("temporal_split = 'test'"), train, "who", "seen")
    return r.groupBy(F.col("seen").cast("long").alias("seen"),
                     F.col("who").isNull().cast("long").alias("is_null")).agg(F.count(F.lit(1)).alias("n"))


def l10_augment(spark, sf):
    ev = scored_events(spark, sf)
    train = ev.filter("temporal_split = 'train'")
    off = T.entity_offsets(train, "user_id", "y", K, 25.0)
    hour = train.withColumn("hr", F.hour("ts"))
    off2 = T.entity_offsets(hour, "hr", "y", K, 25.0)
    s = T.attach_offsets(ev.filter("temporal_split = 'test'").withColumn("hr", F.hour("ts")), off, "user_id", K, "o1")
    s = T.attach_offsets(s, off2, "hr", K, "o2").withColumn("q", T.augment(F.col("p"), F.col("o1"), F.col("o2")))
    return _long(s.select("event_id", "q"), "q").select(
        "event_id", F.col("k").cast("long").alias("k"), F.round("v", 9).alias("v"))


def l8_expand(spark, sf):
    s = scored_events(spark, sf).filter("temporal_split = 'test'")
    q = T.expand_classes(F.slice("p", 1, 3), [0, 2, 3], K)
    return _long(s.select("event_id", q.alias("q")), "q").select(
        "event_id", F.col("k").cast("long").alias("k"), F.round("v", 9).alias("v"))


def a22_valence_moments(spark, sf):
    m = event_marginal(event_split(spark, sf))
    mean, var = I.valence_moments(F.col("probs"), EVENT_VALENCE)
    return m.select(F.round(mean, 9).alias("vbar"), F.round(var, 9).alias("tau"))


def _residuals(spark, sf):
    ev = scored_events(spark, sf)
    return ev.withColumn("s", I.residual_signal(F.col("p"), F.col("y"), EVENT_VALENCE))


def l13_residual(spark, sf):
    return _residuals(spark, sf).select("event_id", F.round("s", 9).alias("s"))


def _moments(spark, sf):
    mean, var = I.valence_moments(F.col("probs"), EVENT_VALENCE)
    return event_marginal(event_split(spark, sf)).select(mean.alias("vbar"), var.alias("tau"))


def l14_tilt(spark, sf):
    r = _residuals(spark, sf).select("event_id", "user_id", "ts", "y", "p", "s")
    t = I.causal_mean(r, F.col("s"), ["user_id"], EV_ORDER, 10.0, day_chunk())
    mo = _moments(spark, sf)
    t = t.withColumns({"vbar": mo.select("vbar").scalar(), "tau": mo.select("tau").scalar()})
    q = I.tilt(F.col("p"), F.col("theta"), EVENT_VALENCE, F.col("vbar"), F.col("tau"))
    return _long(t.select("event_id", q.alias("q")), "q").select(
        "event_id", F.col("k").cast("long").alias("k"), F.round("v", 8).alias("v"))


def c1_temperature(spark, sf):
    """NLL curve over the first-pass temperature grid on the val split."""
    s = scored_events(spark, sf).filter("temporal_split = 'val'")
    c = tuning.temperature_curve(s, "p", "y", (0.25, 0.5, 0.8, 1.0, 1.25, 2.0, 5.0))
    return c.select("temperature", F.round("nll", 9).alias("nll"))


def l11_lambda_curve(spark, sf):
    ev = scored_events(spark, sf)
    train, val = ev.filter("temporal_split = 'train'"), ev.filter("temporal_split = 'val'")
    c = tuning.lambda_curve(train, val, "p", "y", K, ["user_id"], I.LAMBDA_GRID)
    return c.select(F.col("param").alias("lam"), F.round("nll", 9).alias("nll"))


def l15_kappa_curve(spark, sf):
    r = _residuals(spark, sf).select("event_id", "user_id", "ts", "y", "p", "s")
    mo = _moments(spark, sf)
    r = r.withColumns({"vbar": mo.select("vbar").scalar(), "tau": mo.select("tau").scalar()})
    c = tuning.kappa_curve(r, "p", "y", "s", ["user_id"], EV_ORDER, EVENT_VALENCE, F.col("vbar"),
                           F.col("tau"), I.KAPPA_GRID, day_chunk())
    return c.select(F.col("param").alias("kappa"), F.round("nll", 8).alias("nll"))


def o4_arg_min(spark, sf):
    c = l11_lambda_curve(spark, sf)
    return tuning.arg_min(c, "lam", "nll")


QUERIES = {f.__name__: f for f in (
    a12_laplace, a13_group_rate, a14_rollup, a15_shrunk_table, j7_prefix_fallback, a27_lattice_counts,
    a16_entity_offsets, j5_effect_lookup, j6_seen_flag, l10_augment, l8_expand, a22_valence_moments,
    l13_residual, l14_tilt, c1_temperature, l11_lambda_curve, l15_kappa_curve, o4_arg_min)}

_BAND = SQL_LINES + """,
b AS (SELECT *, (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT + (l_quantity >= 40)::INT AS qb,
  (l_discount >= 0.035)::INT + (l_discount >= 0.075)::INT AS db, (l_returnflag = 'R')::INT AS y FROM lines)"""


def _roll(where: str, tau: float) -> str:
    return f""",
t AS (SELECT l_linestatus, qb, db, 3 - (grouping(l_linestatus) + grouping(qb) + grouping(db)) AS depth,
  count(*) AS n, sum(y)::DOUBLE AS y FROM b WHERE temporal_split = 'train' {where} GROUP BY ROLLUP (l_linestatus, qb, db)),
e0 AS (SELECT y / n AS e, n FROM t WHERE depth = 0),
e1 AS (SELECT l_linestatus, t.n, (y + {tau} * e) / (t.n + {tau}) AS e FROM t, e0 WHERE depth = 1),
e2 AS (SELECT l_linestatus, t.qb, t.n, (t.y + {tau} * e) / (t.n + {tau}) AS e FROM t JOIN e1 USING (l_linestatus) WHERE depth = 2),
e3 AS (SELECT l_linestatus, qb, t.db, t.n, (t.y + {tau} * e) / (t.n + {tau}) AS e FROM t JOIN e2 USING (l_linestatus, qb) WHERE depth = 3)"""


def _offsets(src: str, who: str, k: int, lam: float, name: str) -> str:
    """Offset lists per entity from (who, y) rows of ``src``."""
    return f""",
{name}_m AS (SELECT k, (count(y) + 1.0) / ((SELECT count(*) FROM {src}) + {k}) AS q
  FROM (SELECT unnest(range({k})) AS k) LEFT JOIN (SELECT y FROM {src}) ON y = k GROUP BY k),
{name}_c AS (SELECT {who} AS who, k, count(*) FILTER (y = k) AS c, count(*) AS n
  FROM (SELECT {who}, y FROM {src} WHERE {who} IS NOT NULL), (SELECT unnest(range({k})) AS k) GROUP BY {who}, k),
{name} AS (SELECT who, any_value(n) AS n, list(ln((c + {lam} * q) / (n + {lam})) - ln(q) ORDER BY k) AS o
  FROM {name}_c JOIN {name}_m USING (k) GROUP BY who)"""


_SUPP = SQL_LINES + """,
li AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
  CASE WHEN l_discount > 0.005 THEN l_partkey END AS who FROM lines),
str AS (SELECT * FROM li WHERE temporal_split = 'train'),
ste AS (SELECT * FROM li WHERE temporal_split = 'test')"""
_V = "[1.0, 0.0, 6.0, 2.0, 3.0]"
_SOFT = "list_transform(range(5), lambda i: z[i + 1] / list_sum(z))"
_RES = SQL_EVENT_SCORED + f""",
mo AS (SELECT list_sum(list_transform(range(5), lambda i: pm[i + 1] * {_V}[i + 1])) AS vbar,
  list_sum(list_transform(range(5), lambda i: pm[i + 1] * {_V}[i + 1] * {_V}[i + 1])) AS m2 FROM mp),
mom AS (SELECT vbar, m2 - vbar * vbar AS tau FROM mo),
res AS (SELECT event_id, user_id, ts, y, p, {_V}[y + 1]
  - list_sum(list_transform(range(5), lambda i: p[i + 1] * {_V}[i + 1])) AS s FROM escored)"""


def _theta(kappa: str) -> str:
    return (f"coalesce(sum(s) OVER w, 0) / (count(*) OVER w + {kappa})")


_WIN = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_TRAIN_EV = ", etr AS (SELECT * FROM escored WHERE temporal_split = 'train'), eva AS (SELECT * FROM escored WHERE temporal_split = 'val')"

SQL = {
    "a12_laplace": f"WITH {SQL_EVENT_SCORED} SELECT k AS y, round(pbar, 12) AS p FROM marg",
    "a13_group_rate": f"""WITH {SQL_LINES} SELECT round(avg(y), 12) AS base_rate, count(*) AS n_groups FROM
      (SELECT arg_min((l_returnflag = 'R')::INT, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS y
       FROM lines WHERE temporal_split = 'train' GROUP BY l_orderkey)""",
    "a14_rollup": f"""WITH {_BAND}{_roll("", 200.0)} SELECT coalesce(l_linestatus, '*') AS l_linestatus,
      coalesce(qb, -1)::BIGINT AS qb, coalesce(db, -1)::BIGINT AS db, depth::BIGINT AS depth, n, y FROM t""",
    "a15_shrunk_table": f"""WITH {_BAND}{_roll("", 200.0)}
      SELECT '*' AS l_linestatus, -1::BIGINT AS qb, -1::BIGINT AS db, 0::BIGINT AS depth, n, round(e, 9) AS e_y FROM e0
      UNION ALL SELECT l_linestatus, -1, -1, 1, n, round(e, 9) FROM e1
      UNION ALL SELECT l_linestatus, qb, -1, 2, n, round(e, 9) FROM e2
      UNION ALL SELECT l_linestatus, qb, db, 3, n, round(e, 9) FROM e3""",
    "j7_prefix_fallback": f"""WITH {_BAND}{_roll("", 50.0)}
      SELECT (CASE WHEN e3.e IS NOT NULL THEN 3 WHEN e2.e IS NOT NULL THEN 2 WHEN e1.e IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS found_depth,
        count(*) AS n, round(sum(coalesce(e3.e, e2.e, e1.e, e0.e)), 6) AS sum_e
      FROM b LEFT JOIN e3 ON (b.l_linestatus, b.qb, b.db) = (e3.l_linestatus, e3.qb, e3.db)
        LEFT JOIN e2 ON (b.l_linestatus, b.qb) = (e2.l_linestatus, e2.qb)
        LEFT JOIN e1 ON b.l_linestatus = e1.l_linestatus, e0
      WHERE temporal_split = 'test' GROUP BY 1""",
    "a27_lattice_counts": f"""WITH {_BAND} SELECT st, q.qb, d.db, count(b.y) AS n FROM range(2) s(st), range(5) q(qb), range(3) d(db)
      LEFT JOIN b ON (b.l_linestatus <> 'F')::INT = st AND b.qb = q.qb AND b.db = d.db GROUP BY ALL""",
    "a16_entity_offsets": f"""WITH {SQL_EVENTS}, src AS (SELECT y, CASE WHEN value > 2 THEN user_id END AS who0 FROM ev
      WHERE temporal_split = 'train'){_offsets("src", "who0", 5, 25.0, "off")}
      SELECT who, n, k, round(o[k + 1], 9) AS v FROM off, (SELECT unnest(range(5)) AS k)""",
    "j5_effect_lookup": f"""WITH {_SUPP}{_offsets("str", "who", 3, 10.0, "off")}
      SELECT l_returnflag, round(sum(coalesce(o[1], 0.0)), 6) AS o0, round(sum(coalesce(o[2], 0.0)), 6) AS o1,
        round(sum(coalesce(o[3], 0.0)), 6) AS o2 FROM ste LEFT JOIN off ON ste.who = off.who GROUP BY 1""",
    "j6_seen_flag": f"""WITH {_SUPP} SELECT (coalesce(who IN (SELECT who FROM str WHERE who IS NOT NULL), false))::BIGINT AS seen,
      (who IS NULL)::BIGINT AS is_null, count(*) AS n FROM ste GROUP BY ALL""",
    "l10_augment": f"""WITH {SQL_EVENT_SCORED}, etr AS (SELECT *, hour(ts) AS hr FROM escored WHERE temporal_split = 'train')
      {_offsets("etr", "user_id", 5, 25.0, "ou")}{_offsets("etr", "hr", 5, 25.0, "oh")},
      z AS (SELECT event_id, list_transform(range(5), lambda i: exp(ln(p[i + 1]) + coalesce(ou.o[i + 1], 0.0) + coalesce(oh.o[i + 1], 0.0))) AS z
        FROM escored e LEFT JOIN ou ON e.user_id = ou.who LEFT JOIN oh ON hour(e.ts) = oh.who WHERE temporal_split = 'test')
      SELECT event_id, k, round(z[k + 1] / list_sum(z), 9) AS v FROM z, (SELECT unnest(range(5)) AS k)""",
    "l8_expand": f"""WITH {SQL_EVENT_SCORED}, z AS (SELECT event_id, [p[1], 1e-12, p[2], p[3], 1e-12] AS z FROM escored
      WHERE temporal_split = 'test') SELECT event_id, k, round(z[k + 1] / list_sum(z), 9) AS v FROM z, (SELECT unnest(range(5)) AS k)""",
    "a22_valence_moments": f"WITH {_RES} SELECT round(vbar, 9) AS vbar, round(tau, 9) AS tau FROM mom",
    "l13_residual": f"WITH {_RES} SELECT event_id, round(s, 9) AS s FROM res",
    "l14_tilt": f"""WITH {_RES}, th AS (SELECT event_id, p, {_theta("10.0")} AS th FROM res {_WIN}),
      z AS (SELECT event_id, list_transform(range(5), lambda i: exp(ln(p[i + 1]) + th * ({_V}[i + 1] - vbar) / tau)) AS z FROM th, mom)
      SELECT event_id, k, round(z[k + 1] / list_sum(z), 8) AS v FROM z, (SELECT unnest(range(5)) AS k)""",
    "c1_temperature": f"""WITH {SQL_EVENT_SCORED} SELECT t AS temperature, round(avg(ln(list_sum(list_transform(range(5),
      lambda i: exp((ln(p[i + 1]) - ln(p[y + 1])) / t))))), 9) AS nll
      FROM escored, (SELECT unnest([0.25, 0.5, 0.8, 1.0, 1.25, 2.0, 5.0])::DOUBLE AS t) WHERE temporal_split = 'val' GROUP BY t""",
    "l11_lambda_curve": f"""WITH {SQL_EVENT_SCORED}{_TRAIN_EV},
      lm AS (SELECT unnest([25.0, 50.0, 100.0, 200.0, 400.0, 800.0, 1600.0, 3200.0])::DOUBLE AS lam),
      uc AS (SELECT user_id, k, count(*) FILTER (y = k) AS c, count(*) AS n FROM (SELECT user_id, y FROM etr), cls GROUP BY user_id, k),
      mg AS (SELECT k, (count(y) + 1.0) / ((SELECT count(*) FROM etr) + 5) AS q FROM cls LEFT JOIN (SELECT y FROM etr) ON y = k GROUP BY k),
      ul AS (SELECT user_id, lam, list((c + lam * q) / (n + lam) / q ORDER BY k) AS o FROM uc JOIN mg USING (k), lm GROUP BY ALL),
      z AS (SELECT lm.lam, y, list_transform(range(5), lambda i: p[i + 1] * coalesce(o[i + 1], 1.0)) AS z
        FROM eva CROSS JOIN lm LEFT JOIN ul ON eva.user_id = ul.user_id AND lm.lam = ul.lam)
      SELECT lam, round(avg(ln(list_sum(z)) - ln(z[y + 1])), 9) AS nll FROM z GROUP BY lam""",
    "l15_kappa_curve": f"""WITH {_RES}, sm AS (SELECT y, p, coalesce(sum(s) OVER w, 0) AS sb, count(*) OVER w AS nb FROM res {_WIN}),
      kp AS (SELECT unnest([2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 600.0])::DOUBLE AS kappa),
      z AS (SELECT kappa, y, list_transform(range(5), lambda i: exp(ln(p[i + 1]) + sb / (nb + kappa) * ({_V}[i + 1] - vbar) / tau)) AS z FROM sm, mom, kp)
      SELECT kappa, round(avg(ln(list_sum(z)) - ln(z[y + 1])), 8) AS nll FROM z GROUP BY kappa""",
}
SQL["o4_arg_min"] = f"""SELECT lam AS best FROM ({SQL['l11_lambda_curve']}) ORDER BY nll, lam LIMIT 1"""
