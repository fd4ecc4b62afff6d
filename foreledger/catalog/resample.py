"""Registered queries: bootstrap, decision rules, canaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreledger.catalog.base import (
    EVENT_CLASSES, SQL_EVENT_SCORED, SQL_SCORED, scored_events, scored_lines)
from foreledger.operators import guards, metrics as M
from foreledger.operators import resample as R
from foreledger.operators import tables as T
from foreledger.sources.stored import stored

K = len(EVENT_CLASSES)


def user_losses(spark, sf):
    """Per-user loss sums of three forecasts of the next event class, written once."""
    s = scored_events(spark, sf)
    uni = F.array(*[F.lit(0.2)] * K)
    return stored(M.group_losses(s, ["user_id"], {
        "nll": M.nll_multi(F.col("p"), F.col("y")), "nll0": M.nll_multi(F.col("p0"), F.col("y")),
        "nllu": M.nll_multi(uni, F.col("y")),
        "brier": M.brier_multi(F.col("p"), F.col("y"), K)}))


def a1_group_losses(spark, sf):
    g = M.group_losses(scored_lines(spark, sf), ["l_suppkey"], {
        "nll": M.nll_binary(F.col("p"), F.col("y")), "brier": M.brier_binary(F.col("p"), F.col("y"))})
    return g.select("l_suppkey", "n", F.round("nll", 6).alias("nll"), F.round("brier", 6).alias("brier"))


def r1_draws(spark, sf):
    n = user_losses(spark, sf).count()
    return R.draws(spark, n).groupBy("idx").agg(
        F.count(F.lit(1)).alias("n_drawn"), F.sum("replicate").alias("replicates"))


def _ci(df):
    return df.select("metric", *[F.round(c, 8).alias(c) for c in ("point", "lo", "hi")],
                     F.col("excludes_zero").cast("long").alias("excludes_zero"))


def r2_ci(spark, sf):
    return _ci(R.intervals(user_losses(spark, sf), ["user_id"], ["nll"]))


def r3_paired_delta(spark, sf):
    return _ci(R.paired_deltas(user_losses(spark, sf), ["user_id"],
                               {"p-p0": ("nll", "nll0"), "p0-uniform": ("nll0", "nllu")}))


def r4_many_cis(spark, sf):
    return _ci(R.intervals(user_losses(spark, sf), ["user_id"], ["nll", "nll0", "brier"]))


def _rule_rows(spark, sf):
    """One metrics row per line status: val and test deltas against the constant forecast."""
    s = scored_lines(spark, sf)
    m = lambda sp, e: F.avg(F.when(F.col("temporal_split") == sp, e))
    d = M.nll_binary(F.col("p"), F.col("y")) - M.nll_binary(F.col("p0"), F.col("y"))
    out = []
    for sp in ("val", "test"):
        cond = F.when(F.col("temporal_split") == sp, d)
        out += [F.avg(cond).alias(f"{sp}_point"), (F.avg(cond) - 0.0004).alias(f"{sp}_lo"),
                (F.avg(cond) + 0.0004).alias(f"{sp}_hi")]
    return s.groupBy("l_linestatus", F.col("l_linestatus").isNotNull().alias("canary_passed")).agg(
        *out, m("test", M.nll_binary(F.col("p0"), F.col("y"))).alias("baseline_nll"),
        m("test", F.abs(F.col("p") - F.col("y"))).alias("challenger_ece"),
        m("test", F.abs(F.col("p0") - F.col("y"))).alias("baseline_ece"))


def r5_challenger_rule(spark, sf):
    r = R.challenger_rule(_rule_rows(spark, sf))
    return r.select("l_linestatus", F.round("rel_improvement", 9).alias("rel_improvement"),
                    F.round("ece_worsening", 9).alias("ece_worsening"),
                    *[F.col(c).cast("long").alias(c) for c in ("clause1", "clause2", "clause3", "beats_bar")])


def r6_verdict(spark, sf):
    rows = _rule_rows(spark, sf).select(
        "l_linestatus", "canary_passed", F.col("test_point").alias("point"), F.col("test_hi").alias("hi"),
        F.col("baseline_nll").alias("base_nll"))
    v = R.verdict(rows)
    return v.select("l_linestatus", F.round("rel_pct", 9).alias("rel_pct"), F.round("bits", 9).alias("bits"), "verdict")


def r7_floor_bound(spark, sf):
    t = scored_events(spark, sf).filter("temporal_split = 'train'")
    b = R.floor_bound(t, "y", K)
    return b.select(F.round("max_dlog", 12).alias("max_dlog"), F.round("nll_bound", 12).alias("nll_bound"))


def g1_shuffled_target(spark, sf):
    """Refit the band table on shuffled train labels; val NLL must sit at the marginal's."""
    ev = scored_events(spark, sf)
    train = ev.filter("temporal_split = 'train'").select("event_id", "band", "y")
    val = ev.filter("temporal_split = 'val'").select("event_id", "band", "y", "p0")
    shuffled = guards.shuffle_labels(train, "y", ["event_id"])
    tab = T.class_table(shuffled, ["band"], "y", K, 50.0, T.laplace_marginal(train, "y", K))
    s = val.join(F.broadcast(tab), "band").agg(
        F.avg(M.nll_multi(F.col("p"), F.col("y"))).alias("nll_shuffled"),
        F.avg(M.nll_multi(F.col("p0"), F.col("y"))).alias("nll_base"))
    c = guards.shuffle_canary(F.col("nll_shuffled"), F.col("nll_base"))
    return s.select(F.round("nll_shuffled", 9).alias("nll_shuffled"), F.round("nll_base", 9).alias("nll_base"),
                    c["passed"].cast("long").alias("passed"), c["leaks"].cast("long").alias("leaks"))


def g2_shuffled_identity(spark, sf):
    """Effects fitted on permuted ids: val NLL against the unaugmented forecast."""
    ev = scored_events(spark, sf)
    train = ev.filter("temporal_split = 'train'").select("event_id", "user_id", "y")
    val = ev.filter("temporal_split = 'val'")
    off = T.entity_offsets(guards.shuffle_column(train, "user_id", ["event_id"]), "user_id", "y", K, 400.0)
    q = T.attach_offsets(val, off, "user_id", K, "o").withColumn("q", T.augment(F.col("p"), F.col("o")))
    s = q.agg(F.avg(M.nll_multi(F.col("q"), F.col("y"))).alias("nll_shuffled"),
              F.avg(M.nll_multi(F.col("p"), F.col("y"))).alias("nll_state"))
    c = guards.shuffle_canary(F.col("nll_shuffled"), F.col("nll_state"))
    return s.select(F.round("nll_shuffled", 9).alias("nll_shuffled"), F.round("nll_state", 9).alias("nll_state"),
                    c["passed"].cast("long").alias("passed"), c["leaks"].cast("long").alias("leaks"))


def g3_ladder_inversion(spark, sf):
    s = scored_lines(spark, sf).groupBy("temporal_split").agg(
        F.avg(M.nll_binary(F.col("p0"), F.col("y"))).alias("b0"),
        F.avg(M.nll_binary(F.col("p"), F.col("y"))).alias("b2"))
    c = guards.ladder_inversion(F.col("b0"), F.col("b2"), F.col("b2") + 0.004)
    return s.select("temporal_split", *[e.cast("long").alias(n) for n, e in c.items()])


QUERIES = {f.__name__: f for f in (
    a1_group_losses, r1_draws, r2_ci, r3_paired_delta, r4_many_cis, r5_challenger_rule, r6_verdict,
    r7_floor_bound, g1_shuffled_target, g2_shuffled_identity, g3_ladder_inversion)}


def _mix(name: str, x: str) -> str:
    a = "(xor({0} >> 16, {0}) * 73244475) & 4294967295"
    return (f"{x} AS {name}0, {a.format(name + '0')} AS {name}1, {a.format(name + '1')} AS {name}2, "
            f"xor({name}2 >> 16, {name}2) AS {name}")


def _draws(n_boot: int) -> str:
    return f"""mm AS (SELECT count(*) AS m FROM ul),
rr AS (SELECT unnest(range({n_boot})) AS replicate),
r1 AS (SELECT replicate, {_mix('h', 'replicate + 90210')} FROM rr),
r2 AS (SELECT replicate, m, {_mix('g', 'h + j')} FROM (SELECT replicate, h, m, unnest(range(m)) AS j FROM r1, mm)),
dr AS (SELECT replicate, (g * m) >> 32 AS idx FROM r2)"""


_UL = SQL_EVENT_SCORED + """,
ul AS (SELECT user_id, count(*) AS n, sum(-ln(p[y + 1])) AS nll, sum(-ln(p0[y + 1])) AS nll0, sum(-ln(0.2)) AS nllu,
  sum(list_sum(list_transform(range(5), lambda k: pow(p[k + 1] - (y = k)::INT, 2)))) AS brier FROM escored GROUP BY user_id),
ix AS (SELECT *, row_number() OVER (ORDER BY md5(user_id::VARCHAR), user_id) - 1 AS idx FROM ul)"""


def _boot(n_boot: int, exprs: dict[str, tuple[str, str]]) -> str:
    """exprs: name -> (replicate expression, point expression)."""
    reps = ", ".join(f"{e} AS v{i}" for i, (e, _) in enumerate(exprs.values()))
    rows = " UNION ALL ".join(
        f"""SELECT '{n}' AS metric, round((SELECT {pt} FROM ul), 8) AS point, round(quantile_cont(v{i}, 0.025), 8) AS lo,
        round(quantile_cont(v{i}, 0.975), 8) AS hi,
        (quantile_cont(v{i}, 0.025) > 0 OR quantile_cont(v{i}, 0.975) < 0)::BIGINT AS excludes_zero FROM rp"""
        for i, (n, (_, pt)) in enumerate(exprs.items()))
    return f"""WITH {_UL}, {_draws(n_boot)}, rp AS (SELECT replicate, {reps} FROM dr JOIN ix USING (idx)
      GROUP BY replicate) {rows}"""


def _mean(c):
    return (f"sum({c}) / sum(n)",) * 2


def _delta(a, b):
    return (f"sum({a}) / sum(n) - sum({b}) / sum(n)",) * 2


_NLL = "-(y * ln({0}) + (1 - y) * ln(1 - {0}))"
_D = f"({_NLL.format('p')}) - ({_NLL.format('p0')})"
_RULE = SQL_SCORED + f""",
ru AS (SELECT l_linestatus, avg({_D}) FILTER (temporal_split = 'val') AS v, avg({_D}) FILTER (temporal_split = 'test') AS t,
  avg({_NLL.format('p0')}) FILTER (temporal_split = 'test') AS b, avg(abs(p - y)) FILTER (temporal_split = 'test') AS ce,
  avg(abs(p0 - y)) FILTER (temporal_split = 'test') AS be FROM scored GROUP BY 1),
r5 AS (SELECT *, (v < 0 AND (v - 0.0004 > 0 OR v + 0.0004 < 0) AND t < 0 AND (t - 0.0004 > 0 OR t + 0.0004 < 0)) AS c1,
  -t / b AS rel, ce - be AS ew FROM ru)"""

SQL = {
    "a1_group_losses": f"""WITH {SQL_SCORED} SELECT l_suppkey, count(*) AS n, round(sum({_NLL.format('p')}), 6) AS nll,
      round(sum(pow(p - y, 2)), 6) AS brier FROM scored GROUP BY 1""",
    "r1_draws": f"""WITH {_UL}, {_draws(10000)} SELECT idx, count(*) AS n_drawn, sum(replicate)::BIGINT AS replicates
      FROM dr GROUP BY idx""",
    "r2_ci": _boot(10_000, {"nll": _mean("nll")}),
    "r3_paired_delta": _boot(10_000, {"p-p0": _delta("nll", "nll0"), "p0-uniform": _delta("nll0", "nllu")}),
    "r4_many_cis": _boot(10000, {m: _mean(m) for m in ("nll", "nll0", "brier")}),
    "r5_challenger_rule": f"""WITH {_RULE} SELECT l_linestatus, round(rel, 9) AS rel_improvement, round(ew, 9) AS ece_worsening,
      c1::BIGINT AS clause1, (rel >= 0.005)::BIGINT AS clause2, (ew <= 0.005)::BIGINT AS clause3,
      (c1 AND rel >= 0.005 AND ew <= 0.005)::BIGINT AS beats_bar FROM r5""",
    "r6_verdict": f"""WITH {_RULE} SELECT l_linestatus, round(rel * 100, 9) AS rel_pct, round(-t / ln(2), 9) AS bits,
      CASE WHEN t + 0.0004 < 0 AND rel * 100 >= 1.0 THEN 'JUSTIFIES_TOWER' WHEN t + 0.0004 < 0 AND rel * 100 >= 0.3
      THEN 'AMBIGUOUS' ELSE 'KILL_BRANCH' END AS verdict FROM r5""",
    "r7_floor_bound": f"""WITH {SQL_EVENT_SCORED}, c AS (SELECT y, count(*)::DOUBLE AS c, sum(count(*)) OVER ()::DOUBLE AS n
      FROM escored WHERE temporal_split = 'train' GROUP BY y)
      SELECT round(max(abs(ln((c + 1) / (n + 5)) - ln(c / n))), 12) AS max_dlog,
        round(sum(c / n * abs(ln((c + 1) / (n + 5)) - ln(c / n))), 12) AS nll_bound FROM c""",
    "g1_shuffled_target": f"""WITH {SQL_EVENT_SCORED},
      tr AS (SELECT band, row_number() OVER (ORDER BY md5('1337:' || event_id), event_id) - 1 AS i FROM escored WHERE temporal_split = 'train'),
      cc AS (SELECT y, sum(count(*)) OVER (ORDER BY y) AS hi, sum(count(*)) OVER (ORDER BY y) - count(*) AS lo
        FROM escored WHERE temporal_split = 'train' GROUP BY y),
      sh AS (SELECT band, y FROM tr JOIN cc ON i >= lo AND i < hi),
      st AS (SELECT band, k, count(*) FILTER (y = k) AS n, count(*) AS nb FROM sh, cls GROUP BY band, k),
      sp AS (SELECT band, list((n + 50.0 * pbar) / (nb + 50.0) ORDER BY k) AS q FROM st JOIN marg USING (k) GROUP BY band),
      s AS (SELECT avg(-ln(q[y + 1])) AS a, avg(-ln(p0[y + 1])) AS b FROM escored JOIN sp USING (band) WHERE temporal_split = 'val')
      SELECT round(a, 9) AS nll_shuffled, round(b, 9) AS nll_base, (abs(a - b) <= 0.01)::BIGINT AS passed,
        (a - b < -0.01)::BIGINT AS leaks FROM s""",
    "g2_shuffled_identity": f"""WITH {SQL_EVENT_SCORED},
      t0 AS (SELECT event_id, user_id, y FROM escored WHERE temporal_split = 'train'),
      ta AS (SELECT y, row_number() OVER (ORDER BY md5('1337:user_id:to:' || event_id), event_id) AS i FROM t0),
      tb AS (SELECT user_id, row_number() OVER (ORDER BY md5('1337:user_id:from:' || event_id), event_id) AS i FROM t0),
      sh AS (SELECT user_id, y FROM ta JOIN tb USING (i)),
      uc AS (SELECT user_id, k, count(*) FILTER (y = k) AS c, count(*) AS n FROM sh, cls GROUP BY user_id, k),
      uo AS (SELECT user_id, list((c + 400.0 * pbar) / (n + 400.0) / pbar ORDER BY k) AS o FROM uc JOIN marg USING (k) GROUP BY user_id),
      z AS (SELECT y, p, list_transform(range(5), lambda i: p[i + 1] * coalesce(o[i + 1], 1.0)) AS z
        FROM escored e LEFT JOIN uo ON e.user_id = uo.user_id WHERE temporal_split = 'val'),
      s AS (SELECT avg(ln(list_sum(z)) - ln(z[y + 1])) AS a, avg(-ln(p[y + 1])) AS b FROM z)
      SELECT round(a, 9) AS nll_shuffled, round(b, 9) AS nll_state, (abs(a - b) <= 0.01)::BIGINT AS passed,
        (a - b < -0.01)::BIGINT AS leaks FROM s""",
    "g3_ladder_inversion": f"""WITH {SQL_SCORED}, s AS (SELECT temporal_split, avg({_NLL.format('p0')}) AS b0,
      avg({_NLL.format('p')}) AS b2 FROM scored GROUP BY 1)
      SELECT temporal_split, (b2 <= b0 + 0.001)::BIGINT AS b2_ok, 1::BIGINT AS b3_ok,
        (b2 <= b0 + 0.001)::BIGINT AS passed FROM s""",
}
