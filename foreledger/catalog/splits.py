"""Registered queries: splits, features, labels, joins, validation of plain columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreledger.catalog.base import (
    LI_KEY, LI_ORDER, SQL_BOUNDS, SQL_LINES, bounds, lines_split, orders_split, table)
from foreledger.functions import band_left, band_right
from foreledger.operators import census, features, guards, labels, splits


def _s(c):
    return F.col(c).cast("date").cast("string").alias(c)


def a23_temporal_bounds(spark, sf):
    return bounds(spark, sf).select(_s("b1"), _s("b2"))


def a24_split_counts(spark, sf):
    o = orders_split(spark, sf)
    li = lines_split(spark, sf)
    m = splits.split_metadata(o, li, "start_date")
    return m.select("temporal_split", _s("lo"), _s("hi"), "n_groups", "n_facts")


def a5_format_metadata(spark, sf):
    o, li = orders_split(spark, sf, "o_orderstatus"), lines_split(spark, sf, "o_orderstatus")
    m = splits.split_metadata(o, li, "start_date", "o_orderstatus")
    return m.select("o_orderstatus", "temporal_split", _s("lo"), _s("hi"), "n_groups", "n_facts")


def v17_split_violations(spark, sf):
    """Facts labelled by ship date, so they disagree with their order's split."""
    o = orders_split(spark, sf).withColumn("temporal_split", F.when(
        F.col("start_date") == F.lit("1995-01-01").cast("date"), "holdout").otherwise(F.col("temporal_split")))
    li = splits.assign_split(
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"),
                                            F.to_date("l_shipdate").alias("d")),
        "d", bounds(spark, sf))
    return splits.split_violations(o, li, "o_orderkey", "start_date")


def p10_slice_rows(spark, sf):
    li = lines_split(spark, sf).withColumn("fmt", F.when(F.col("l_linestatus") == "F", "t20").otherwise("odi"))
    rows = features.slice_rows(li, "t20", "val")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


def p12_strict_encode(spark, sf):
    li = table(spark, sf, "lineitem")
    y = features.strict_encode(F.col("l_returnflag"), ("A", "N", "R"))
    return li.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n"))


def _ball_columns():
    return {
        "wickets_n": F.when(F.col("l_discount") > 0.09, 1).otherwise(0),
        "wides": F.when(F.col("l_tax") > 0.07, 1).otherwise(0),
        "noballs": F.when(F.col("l_tax") < 0.01, 1).otherwise(0),
        "byes": F.when(F.col("l_quantity") > 45, 1).otherwise(0),
        "legbyes": F.when(F.col("l_quantity") < 3, 1).otherwise(0),
        "bat": (F.col("l_quantity") % 9).cast("int"),
    }


def p4_outcome_class(spark, sf):
    li = table(spark, sf, "lineitem").withColumns(_ball_columns())
    c = features.outcome_class(F.col("bat"), F.col("wides"), F.col("noballs"), F.col("byes"),
                               F.col("legbyes"), F.col("wickets_n"))
    return li.groupBy(c.alias("outcome_class"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def fact_view(spark, sf):
    """lineitem dressed as fact rows: every whitelisted source column, plus keys and split."""
    li = lines_split(spark, sf)
    q = F.col("l_quantity")
    low = F.col("l_discount") < 0.005
    return li.withColumns({
        "innings_idx": F.when(F.col("l_linestatus") == "F", 1).otherwise(2),
        "balls_per_over": F.lit(6), "max_balls": F.lit(120),
        "legal_balls": F.least(F.floor(q * 2.3), F.lit(120)).cast("int"),
        "runs": F.floor(q * 3.1).cast("int"),
        "wickets": (F.col("l_linenumber") + 1).cast("int"),
        "in_powerplay": q < 16, "partnership_runs": (q % 17).cast("int"),
        "partnership_balls": (q % 13).cast("int"),
        "striker_id": F.when(~low, F.col("l_partkey").cast("string")),
        "striker_runs": F.when(~low, (q % 31).cast("int")),
        "striker_balls": F.when(~low, (q % 23).cast("int")),
        "non_striker_id": F.col("l_suppkey").cast("string"),
        "non_striker_runs": (q % 29).cast("int"), "non_striker_balls": (q % 19).cast("int"),
        "bowler_id": F.col("l_suppkey").cast("string"),
        "bowler_legal_balls": (q % 24).cast("int"), "bowler_runs_conceded": (q % 37).cast("int"),
        "bowler_wickets": (q % 5).cast("int"),
        "fmt": F.when(F.col("l_tax") < 0.045, "t20").otherwise("odi"),
        "gender": F.when(F.col("l_returnflag") == "N", "female").otherwise("male"),
        "dls_applied": F.col("l_discount") > 0.085, "last_ball_was_noball": F.col("l_tax") > 0.075,
        "target": F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "A"), 161),
        "excluded_from_tuples": F.col("l_returnflag") == "A",
        "outcome_class": F.when(F.col("l_returnflag") == "R", "wicket").otherwise(
            F.when(q % 2 == 0, "0").otherwise("1")),
        "match_id": F.col("l_orderkey").cast("string"),
        "over_number": F.col("l_linenumber"), "ball_in_over": F.col("l_partkey").cast("int"),
    })


def p9_features(spark, sf):
    f = features.build_features(fact_view(spark, sf), LI_KEY)
    return f.select(*LI_KEY[:-1], _s("l_shipdate"), *[
        F.round(c, 6).alias(c) for c in features.FEATURE_COLUMNS], "fmt")


def p11_assemble_outcomes(spark, sf):
    t = features.assemble_outcomes(fact_view(spark, sf), "t20", "train")
    return t.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("runs").alias("runs"),
                              F.round(F.sum("wih_x_rrr"), 4).alias("wih"))


def p15_bands(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        band_right(F.col("l_quantity"), (10, 20, 40)).cast("long").alias("right_band"),
        band_left(F.col("l_quantity"), (10, 20, 40)).cast("long").alias("left_band"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _matches(spark, sf):
    o = orders_split(spark, sf, "o_orderstatus", "o_orderpriority", "o_totalprice")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    tie = pr == "2-HIGH"
    gone = (pr == "1-URGENT") & (st == "P")
    drawn = (pr == "5-LOW") & (st == "P")
    return o.select(
        F.col("o_orderkey").alias("match_id"), "temporal_split", "start_date",
        F.when(F.col("o_totalprice") > 250000, "t20").otherwise("odi").alias("fmt"),
        gone.alias("no_result"),
        F.when(gone, "no result").when(tie, "tie").when(drawn, "draw").alias("outcome_result"),
        F.when(~(gone | tie | drawn), F.when(st == "F", "F").otherwise("O")).alias("outcome_winner"),
        F.when(tie & (st == "F"), "F").alias("outcome_eliminator"),
        F.when(tie & ((st == "O") | ((st == "F") & (F.col("o_totalprice") > 400000))), "O").alias(
            "outcome_bowl_out"))


def _line_facts(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.lit(1).alias("innings_idx"),
        F.col("l_linestatus").alias("batting_team"), F.col("l_linenumber").alias("over_number"),
        F.struct("l_partkey", "l_suppkey", "l_shipdate").alias("ball_in_over"), "l_quantity")


def p16_labels(spark, sf):
    r = labels.resolved_labels(_matches(spark, sf), _line_facts(spark, sf))
    return r.select("match_id", "temporal_split", "fmt", F.coalesce("disposition", F.lit("-")).alias("disposition"),
                    F.coalesce(F.col("y").cast("long"), F.lit(-1)).alias("y"),
                    F.coalesce("error", F.lit("-")).alias("error"))


def a3_disposition_counts(spark, sf):
    r = labels.resolved_labels(_matches(spark, sf), _line_facts(spark, sf)).filter("error is null")
    return labels.disposition_counts(r)


def a11_base_rates(spark, sf):
    r = labels.resolved_labels(_matches(spark, sf), _line_facts(spark, sf)).filter("error is null")
    m = census.conditional_mean(r, ["fmt", "temporal_split"], "y", F.col("disposition") == "LABELED")
    return m.select("fmt", "temporal_split", F.round("mean", 9).alias("mean"), "n")


def j1_labeled_facts(spark, sf):
    facts = _line_facts(spark, sf)
    r = labels.resolved_labels(_matches(spark, sf), facts).filter("disposition = 'LABELED'")
    j = facts.join(r.select("match_id", "temporal_split", "y"), "match_id")
    return j.groupBy("temporal_split", F.col("y").cast("long").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


def j2_first_value(spark, sf):
    f = labels.first_value(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linestatus", LI_ORDER, "first_team")
    o = table(spark, sf, "orders").select("o_orderkey")
    j = o.join(f, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.coalesce("first_team", F.lit("-")).alias("first_team"))


def j3_disagreement(spark, sf):
    b = bounds(spark, sf)
    ship = splits.assign_split(
        table(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("d")), "d", b
    ).select("l_orderkey", F.col("temporal_split").alias("fact_split")).dropDuplicates()
    o = orders_split(spark, sf)
    j = ship.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter("fact_split != temporal_split")
    return j.groupBy("temporal_split", "fact_split").agg(F.count(F.lit(1)).alias("n"))


def v7_reconcile(spark, sf):
    """Lines whose unit price falls below a floor, coded as an accounting defect."""
    li = table(spark, sf, "lineitem")
    ok = F.col("l_extendedprice") / F.col("l_quantity") >= 200
    r = li.withColumn("reason", F.when(ok, "OK").otherwise("E_BALL_ACCOUNTING"))
    return r.groupBy("reason", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def p5_exclusion_flags(spark, sf):
    e = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") > 2).alias("is_super_over"), "l_linenumber", "l_returnflag")
    ex = F.col("is_super_over") | (F.col("l_returnflag") == "A")
    return e.groupBy(F.col("is_super_over").cast("long").alias("is_super_over"),
                     ex.cast("long").alias("excluded_from_tuples")).agg(F.count(F.lit(1)).alias("n"))


def g4_poison_column(spark, sf):
    """Feature rows with and without an injected outcome column: both differences, counted."""
    base = fact_view(spark, sf)
    clean = features.build_features(base, LI_KEY)
    dirty = features.build_features(base.withColumn("outcome_leak", F.rand(7)), LI_KEY)
    return guards.poison_differences(clean, dirty).select("side", "n")


QUERIES = {f.__name__: f for f in (
    a23_temporal_bounds, a24_split_counts, a5_format_metadata, v17_split_violations, p10_slice_rows,
    p12_strict_encode, p4_outcome_class, p9_features, p11_assemble_outcomes, p15_bands, p16_labels,
    a3_disposition_counts, a11_base_rates, j1_labeled_facts, j2_first_value, j3_disagreement,
    v7_reconcile, p5_exclusion_flags, g4_poison_column)}

_FACT = SQL_LINES + """,
fact AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS innings_idx,
  least(floor(l_quantity * 2.3), 120)::INT AS lb, floor(l_quantity * 3.1)::INT AS rn,
  l_linenumber + 1 AS wk, CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'A' THEN 161 END AS target,
  CASE WHEN l_tax < 0.045 THEN 't20' ELSE 'odi' END AS fmt FROM lines),
f1 AS (SELECT *, (innings_idx = 2 AND target IS NOT NULL) AS chase, (120 - lb)::DOUBLE AS br,
  CASE WHEN lb > 0 THEN 6.0 * rn / lb ELSE 0.0 END AS crr FROM fact),
f2 AS (SELECT *, CASE WHEN chase AND br > 0 THEN 6.0 * (target - rn) / br ELSE 0.0 END AS rrr FROM f1),
feat AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate, temporal_split, l_returnflag, l_quantity,
  innings_idx::DOUBLE AS innings_idx, chase::INT::DOUBLE AS is_chase, lb::DOUBLE AS legal_balls,
  br AS balls_remaining, rn::DOUBLE AS runs, wk::DOUBLE AS wickets, (10 - wk)::DOUBLE AS wickets_in_hand,
  round(crr, 6) AS crr, (l_quantity < 16)::INT::DOUBLE AS in_powerplay,
  (l_quantity % 17) AS partnership_runs, (l_quantity % 13) AS partnership_balls,
  CASE WHEN l_discount < 0.005 THEN 0 ELSE l_quantity % 31 END AS striker_runs,
  CASE WHEN l_discount < 0.005 THEN 0 ELSE l_quantity % 23 END AS striker_balls,
  (l_quantity % 29) AS non_striker_runs, (l_quantity % 19) AS non_striker_balls,
  (l_discount < 0.005)::INT::DOUBLE AS new_batter, (l_quantity % 24) AS bowler_legal_balls,
  (l_quantity % 37) AS bowler_runs_conceded, (l_quantity % 5) AS bowler_wickets,
  (l_returnflag = 'N')::INT::DOUBLE AS gender_female, (l_discount > 0.085)::INT::DOUBLE AS dls_applied,
  (l_tax > 0.075)::INT::DOUBLE AS last_ball_was_noball,
  CASE WHEN chase THEN target ELSE 0 END::DOUBLE AS target_runs,
  CASE WHEN chase THEN target - rn ELSE 0 END::DOUBLE AS required_runs, round(rrr, 6) AS rrr,
  round(CASE WHEN chase THEN rrr - crr ELSE 0.0 END, 6) AS rr_gap,
  round((10 - wk) * rrr, 6) AS wih_x_rrr, (10 - wk) * rrr AS wih_raw, fmt FROM f2)"""

_LAB = SQL_BOUNDS + """,
first AS (SELECT l_orderkey, arg_min(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS ft
  FROM lineitem GROUP BY l_orderkey),
m0 AS (SELECT *, o_orderpriority = '2-HIGH' AS tie,
  o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS gone,
  o_orderpriority = '5-LOW' AND o_orderstatus = 'P' AS drawn,
  CASE WHEN o_totalprice > 250000 THEN 't20' ELSE 'odi' END AS fmt
  FROM o_split LEFT JOIN first ON o_orderkey = l_orderkey),
m1 AS (SELECT *, CASE WHEN NOT (gone OR tie OR drawn) THEN CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END END AS winner,
  CASE WHEN tie AND o_orderstatus = 'F' THEN 'F' END AS elim,
  CASE WHEN tie AND (o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_totalprice > 400000)) THEN 'O' END AS bowl FROM m0),
lab AS (SELECT o_orderkey AS match_id, temporal_split, fmt,
  CASE WHEN gone THEN NULL WHEN winner IS NOT NULL AND ft IS NULL THEN 'a winner, but nothing of the first innings'
    WHEN winner IS NOT NULL THEN NULL WHEN tie AND elim IS NOT NULL AND bowl IS NOT NULL THEN 'a tie broken twice'
    WHEN tie AND coalesce(elim, bowl) IS NOT NULL AND ft IS NULL THEN 'a broken tie, but nothing of the first innings'
    WHEN tie THEN NULL ELSE 'an outcome no rule covers' END AS error,
  CASE WHEN gone THEN 'EXCLUDE_NO_RESULT' WHEN winner IS NOT NULL THEN 'LABELED'
    WHEN tie AND coalesce(elim, bowl) IS NULL THEN 'EXCLUDE_TRUE_TIE' WHEN tie THEN 'LABELED' END AS disp,
  CASE WHEN winner IS NOT NULL THEN (winner = ft)::INT WHEN coalesce(elim, bowl) IS NOT NULL
    THEN (coalesce(elim, bowl) = ft)::INT END AS yy FROM m1),
labels_t AS (SELECT match_id, temporal_split, fmt, error,
  CASE WHEN error IS NULL THEN disp END AS disposition, CASE WHEN error IS NULL THEN yy END AS y FROM lab)"""

_SHIP = SQL_BOUNDS + """,
ship AS (SELECT DISTINCT l_orderkey, CASE WHEN CAST(l_shipdate AS DATE) < b1 THEN 'train'
  WHEN CAST(l_shipdate AS DATE) < b2 THEN 'val' ELSE 'test' END AS fact_split FROM lineitem, bounds)"""

_FCOLS = ", ".join(features.FEATURE_COLUMNS)

SQL = {
    "a23_temporal_bounds": f"WITH {SQL_BOUNDS} SELECT b1::VARCHAR AS b1, b2::VARCHAR AS b2 FROM bounds",
    "a24_split_counts": f"""WITH {SQL_LINES} SELECT o.temporal_split, lo, hi, n_groups, n_facts FROM
      (SELECT temporal_split, min(start_date)::VARCHAR AS lo, max(start_date)::VARCHAR AS hi,
        count(*) AS n_groups FROM o_split GROUP BY 1) o
      JOIN (SELECT temporal_split, count(*) AS n_facts FROM lines GROUP BY 1) l USING (temporal_split)""",
    "a5_format_metadata": f"""WITH {SQL_LINES} SELECT o_orderstatus, temporal_split, lo, hi, n_groups, n_facts FROM
      (SELECT o_orderstatus, temporal_split, min(start_date)::VARCHAR AS lo, max(start_date)::VARCHAR AS hi,
        count(*) AS n_groups FROM o_split GROUP BY ALL) o
      JOIN (SELECT o_orderstatus, temporal_split, count(*) AS n_facts FROM lines GROUP BY ALL) l
      USING (o_orderstatus, temporal_split)""",
    "v17_split_violations": f"""WITH {_SHIP},
      dim AS (SELECT o_orderkey, start_date, CASE WHEN start_date = DATE '1995-01-01' THEN 'holdout'
        ELSE temporal_split END AS temporal_split FROM o_split),
      r AS (SELECT s, max(CASE WHEN temporal_split = s THEN start_date END) AS hi,
        min(CASE WHEN temporal_split = s THEN start_date END) AS lo
        FROM dim, (VALUES ('train'), ('val'), ('test')) v(s) GROUP BY s)
      SELECT DISTINCT 'unknown_label' AS "check", temporal_split AS subject, '' AS detail FROM dim
        WHERE temporal_split NOT IN ('train', 'val', 'test')
      UNION ALL SELECT 'several_splits', l_orderkey::VARCHAR, count(*)::VARCHAR FROM ship
        GROUP BY l_orderkey HAVING count(*) > 1
      UNION ALL SELECT 'disagreement', l_orderkey::VARCHAR, fact_split || ' ' || temporal_split
        FROM ship JOIN dim ON l_orderkey = o_orderkey WHERE fact_split <> temporal_split
      UNION ALL SELECT 'empty_split', s, '' FROM r WHERE lo IS NULL
      UNION ALL SELECT 'time_order', a.s || '<' || b.s, a.hi::VARCHAR || ' ' || b.lo::VARCHAR
        FROM r a JOIN r b ON (a.s, b.s) IN (('train', 'val'), ('val', 'test')) WHERE NOT a.hi < b.lo""",
    "p10_slice_rows": f"""WITH {SQL_LINES} SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty
      FROM lines WHERE temporal_split = 'val' AND l_linestatus = 'F' GROUP BY 1""",
    "p12_strict_encode": """SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT AS y,
      count(*) AS n FROM lineitem GROUP BY 1""",
    "p4_outcome_class": """SELECT CASE WHEN l_discount > 0.09 THEN 'wicket' WHEN l_tax > 0.07 THEN 'wide'
      WHEN l_tax < 0.01 THEN 'no_ball' WHEN l_quantity > 45 OR l_quantity < 3 THEN 'bye_legbye'
      WHEN (l_quantity % 9) IN (0, 1, 2, 3, 4, 6) THEN ((l_quantity % 9)::INT)::VARCHAR
      ELSE 'other_runs' END AS outcome_class, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL""",
    "p9_features": f"""WITH {_FACT} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
      {_FCOLS}, fmt FROM feat""",
    "p11_assemble_outcomes": f"""WITH {_FACT} SELECT (CASE WHEN l_returnflag = 'R' THEN 10
      WHEN l_quantity % 2 = 0 THEN 0 ELSE 1 END)::BIGINT AS y, count(*) AS n, sum(runs) AS runs,
      round(sum(wih_raw), 4) AS wih FROM feat WHERE fmt = 't20' AND temporal_split = 'train'
      AND l_returnflag <> 'A' GROUP BY 1""",
    "p15_bands": """SELECT ((l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT)::BIGINT AS right_band,
      ((l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 40)::INT)::BIGINT AS left_band,
      count(*) AS n FROM lineitem GROUP BY ALL""",
    "p16_labels": f"""WITH {_LAB} SELECT match_id, temporal_split, fmt, coalesce(disposition, '-') AS disposition,
      coalesce(y, -1)::BIGINT AS y, coalesce(error, '-') AS error FROM labels_t""",
    "a3_disposition_counts": f"""WITH {_LAB} SELECT temporal_split, disposition, count(*) AS n
      FROM labels_t WHERE error IS NULL GROUP BY ALL""",
    "a11_base_rates": f"""WITH {_LAB} SELECT fmt, temporal_split, round(avg(y), 9) AS mean, count(*) AS n
      FROM labels_t WHERE disposition = 'LABELED' GROUP BY ALL""",
    "j1_labeled_facts": f"""WITH {_LAB} SELECT temporal_split, y::BIGINT AS y, count(*) AS n,
      sum(l_quantity) AS qty FROM lineitem JOIN labels_t ON l_orderkey = match_id
      WHERE disposition = 'LABELED' GROUP BY ALL""",
    "j2_first_value": """SELECT o_orderkey, coalesce(ft, '-') AS first_team FROM orders LEFT JOIN
      (SELECT l_orderkey, arg_min(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS ft
       FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "j3_disagreement": f"""WITH {_SHIP} SELECT temporal_split, fact_split, count(*) AS n FROM ship
      JOIN o_split ON l_orderkey = o_orderkey WHERE fact_split <> temporal_split GROUP BY ALL""",
    "v7_reconcile": """SELECT CASE WHEN l_extendedprice / l_quantity >= 200 THEN 'OK'
      ELSE 'E_BALL_ACCOUNTING' END AS reason, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL""",
    "p5_exclusion_flags": """SELECT (l_linenumber > 2)::BIGINT AS is_super_over,
      (l_linenumber > 2 OR l_returnflag = 'A')::BIGINT AS excluded_from_tuples, count(*) AS n
      FROM lineitem GROUP BY ALL""",
    "g4_poison_column": "SELECT * FROM (VALUES ('clean', 0::BIGINT), ('dirty', 0::BIGINT)) v(side, n)",
}
