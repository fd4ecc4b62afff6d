"""Registered queries: causal means, running state, ledgers, slots, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreledger.catalog.base import EV_ORDER, LI_KEY, LI_ORDER, day_chunk, line_chunk, table
from foreledger.operators import digest, fold, increments

_R = 6


def _events(spark, sf):
    return table(spark, sf, "events")


def w1_causal_mean(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts", "value")
    cents = F.round(F.col("value") * 100)
    r = increments.causal_mean(e, cents, ["user_id"], EV_ORDER, 25.0, day_chunk())
    return r.select("event_id", "user_id", F.col("n_before").cast("long").alias("n_before"),
                    (F.col("theta") / 100).alias("theta"))


def w2_causal_mean_reset(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts", "value", F.to_date("ts").alias("day"))
    cents = F.round(F.col("value") * 100)
    hour = [F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)]
    a = increments.causal_mean(e, cents, ["user_id"], EV_ORDER, 5.0, day_chunk(),
                               "theta_full").drop("n_before")
    b = increments.causal_mean(a, cents, ["user_id", "day"], EV_ORDER, 5.0, hour,
                               "theta_reset")
    return b.select("event_id", F.col("n_before").cast("long").alias("ordinal"),
                    (F.col("theta_full") / 100).alias("theta_full"),
                    (F.col("theta_reset") / 100).alias("theta_reset"))


def w3_local_level_filter(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts", "value")
    r = increments.local_level(e, "value", ["user_id"], EV_ORDER, prior_var=2.0, obs_var=5.0,
                               process_var=0.25, chunk=day_chunk())
    return r.select("event_id", F.round("theta", _R).alias("theta"))


def _state(spark, sf, post=False):
    e = _events(spark, sf).select("event_id", "user_id", "ts", "event_type", "value")
    return fold.running_state(
        e, ["user_id"], EV_ORDER, value=F.col("value"), legal=F.col("event_type") != "signup",
        falls=(F.col("event_type") == "error").cast("int"), flag=F.col("event_type") == "view",
        chunk=day_chunk(), post=post)


def k1_running_state(spark, sf):
    return _state(spark, sf, post=True).select(
        "event_id", F.round("runs", 4).alias("runs"), F.col("legal_balls").cast("long").alias("legal_balls"),
        F.col("wickets").cast("long").alias("wickets"), F.round("post_runs", 4).alias("post_runs"),
        F.col("post_legal_balls").cast("long").alias("post_legal_balls"),
        F.col("post_wickets").cast("long").alias("post_wickets"),
        F.col("last_flag").cast("long").alias("last_flag"),
        F.col("post_last_flag").cast("long").alias("post_last_flag"))


def k4_last_fall(spark, sf):
    return _state(spark, sf).filter("fow_last_ball is not null").select(
        "event_id", F.round("fow_last_runs", 4).alias("fow_last_runs"),
        F.col("fow_last_ball").cast("long").alias("fow_last_ball"))


def k5_partnership(spark, sf):
    return _state(spark, sf).select(
        "event_id", F.round("partnership_runs", 4).alias("partnership_runs"),
        F.col("partnership_balls").cast("long").alias("partnership_balls"))


def k6_actor_ledger(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_KEY, "l_quantity", "l_returnflag")
    r = fold.actor_ledger(
        li, ["l_orderkey"], LI_ORDER, "l_suppkey", chunk=line_chunk(),
        counters={"balls": (F.col("l_returnflag") != "N").cast("int"),
                  "conceded": F.col("l_quantity"),
                  "credited": (F.col("l_returnflag") == "R").cast("int")})
    return r.select(
        *LI_KEY[:-1], F.col("l_shipdate").cast("date").cast("string").alias("l_shipdate"),
        "state_l_suppkey", F.col("balls").cast("long").alias("balls"), "conceded",
        F.col("credited").cast("long").alias("credited"))


def k8_slot_prediction(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "ts", "event_type", "value")
    from foreledger.operators.scan import running

    e = running(e, ["user_id"], EV_ORDER, sums={"n": F.lit(1)},
                lasts={"prev_type": F.col("event_type")}, chunk=day_chunk())
    r = fold.predicted_slots(
        e, ["user_id"], EV_ORDER, first=F.col("event_type"),
        second=F.concat(F.lit("p_"), F.coalesce("prev_type", F.lit("none"))),
        out=F.when(F.col("event_type") == "error", F.array(F.lit("error"))),
        crossings=F.floor("value"), turn_end=(F.col("n") + 1) % 6 == 0, chunk=day_chunk())
    return r.select("event_id", F.coalesce("slot_a", F.lit("-")).alias("slot_a"),
                    F.coalesce("slot_b", F.lit("-")).alias("slot_b"))


def k11_interval_flag(spark, sf):
    e = _events(spark, sf).select("event_id", F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"))
    fix = lambda a, b, c, d: F.struct(
        F.struct(F.lit(a).alias("over"), F.lit(b).alias("ball")).alias("from"),
        F.struct(F.lit(c).alias("over"), F.lit(d).alias("ball")).alias("to"))
    ranges = F.array(fix(2, 6, 5, 12), fix(9, 0, 9, 23), fix(20, 13, 21, 1))
    at = F.struct(F.col("d").alias("over"), F.col("h").alias("ball"))
    return e.select("event_id", fold.in_ranges(at, ranges).cast("long").alias("inside"))


_DIGEST_COLS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


def k15_group_hash(spark, sf):
    o = table(spark, sf, "orders")
    return digest.group_digest(o, ["o_custkey"], _DIGEST_COLS)


def k16_corpus_hash(spark, sf):
    g = k15_group_hash(spark, sf)
    return digest.corpus_digest(g, ["o_custkey", "stream_hash"])


QUERIES = {f.__name__: f for f in (
    w1_causal_mean, w2_causal_mean_reset, w3_local_level_filter, k1_running_state, k4_last_fall,
    k5_partnership, k6_actor_ledger, k8_slot_prediction, k11_interval_flag, k15_group_hash,
    k16_corpus_hash)}

_ST = """WITH base AS (SELECT *, (event_type <> 'signup')::INT AS legal,
    (event_type = 'error')::INT AS fall FROM events),
cum AS (SELECT *, sum(value) OVER w AS r, sum(legal) OVER w AS l, sum(fall) OVER w AS k,
    lag(event_type = 'view') OVER w AS pf FROM base
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, last_value(CASE WHEN fall = 1 THEN r END IGNORE NULLS) OVER p AS fr,
    last_value(CASE WHEN fall = 1 THEN l END IGNORE NULLS) OVER p AS fl FROM cum
  WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
_AT = "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_WORDS = ", ".join(
    f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(digest.WORDS))


def digest_sql(src: str, group: str, text: str, out: str) -> str:
    return (f"SELECT {group + ',' if group else ''} "
            f"sha256(concat_ws(':', count(*)::VARCHAR, {_WORDS})) AS {out} FROM "
            f"(SELECT {group + ',' if group else ''} sha256({text}) AS h FROM {src}) "
            + (f"GROUP BY {group}" if group else ""))


_K15 = digest_sql("orders", "o_custkey",
                   "concat_ws(':', o_orderkey, o_orderstatus, o_orderpriority)", "stream_hash")

SQL = {
    "w1_causal_mean": f"""SELECT event_id, user_id, count(*) OVER w AS n_before,
      coalesce(sum(round(value * 100)) OVER w, 0) / (count(*) OVER w + 25.0) / 100 AS theta
      FROM events WINDOW w AS ({_AT})""",
    "w2_causal_mean_reset": f"""SELECT event_id, count(*) OVER d AS ordinal,
      coalesce(sum(round(value * 100)) OVER w, 0) / (count(*) OVER w + 5.0) / 100 AS theta_full,
      coalesce(sum(round(value * 100)) OVER d, 0) / (count(*) OVER d + 5.0) / 100 AS theta_reset
      FROM events WINDOW w AS ({_AT}),
      d AS ({_AT.replace("user_id ORDER", "user_id, CAST(ts AS DATE) ORDER")})""",
    "w3_local_level_filter": """WITH RECURSIVE e AS (SELECT event_id, user_id, value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT user_id, i, event_id, value, CAST(0.0 AS DOUBLE) AS m, CAST(2.0 AS DOUBLE) AS p
          FROM e WHERE i = 1
        UNION ALL
        SELECT e.user_id, e.i, e.event_id, e.value, f.m + f.p / (f.p + 5.0) * (f.value - f.m),
          (1.0 - f.p / (f.p + 5.0)) * f.p + 0.25
        FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
      SELECT event_id, round(m, 6) AS theta FROM f""",
    "k1_running_state": _ST + """SELECT event_id, round(r - value, 4) AS runs,
      (l - legal)::BIGINT AS legal_balls, (k - fall)::BIGINT AS wickets, round(r, 4) AS post_runs,
      l::BIGINT AS post_legal_balls, k::BIGINT AS post_wickets,
      coalesce(pf, false)::BIGINT AS last_flag, (event_type = 'view')::BIGINT AS post_last_flag
      FROM st""",
    "k4_last_fall": _ST + """SELECT event_id, round(fr, 4) AS fow_last_runs,
      fl::BIGINT AS fow_last_ball FROM st WHERE fl IS NOT NULL""",
    "k5_partnership": """WITH base AS (SELECT *, (event_type <> 'signup')::INT AS legal,
        (event_type = 'error')::INT AS fall FROM events),
      isl AS (SELECT *, sum(fall) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING) - fall AS island FROM base)
      SELECT event_id, round(coalesce(sum(value) OVER w, 0), 4) AS partnership_runs,
        coalesce(sum(legal) OVER w, 0)::BIGINT AS partnership_balls FROM isl
      WINDOW w AS (PARTITION BY user_id, island ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "k6_actor_ledger": """WITH own AS (SELECT *, (l_returnflag <> 'N')::INT AS b,
        (l_returnflag = 'R')::INT AS c FROM lineitem),
      cum AS (SELECT *, sum(b) OVER w AS sb, sum(l_quantity) OVER w AS sq, sum(c) OVER w AS sc,
        row_number() OVER w AS nth FROM own
        WINDOW w AS (PARTITION BY l_orderkey, l_suppkey
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING)),
      p AS (SELECT *, lag(l_suppkey) OVER o AS ps, lag(sb) OVER o AS pb, lag(sq) OVER o AS pq,
        lag(sc) OVER o AS pc FROM cum WINDOW o AS (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate))
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate,
        CASE WHEN nth = 1 AND ps IS NOT NULL THEN ps ELSE l_suppkey END AS state_l_suppkey,
        (CASE WHEN nth = 1 AND ps IS NOT NULL THEN pb ELSE sb - b END)::BIGINT AS balls,
        CASE WHEN nth = 1 AND ps IS NOT NULL THEN pq ELSE sq - l_quantity END AS conceded,
        (CASE WHEN nth = 1 AND ps IS NOT NULL THEN pc ELSE sc - c END)::BIGINT AS credited FROM p""",
    "k8_slot_prediction": """WITH b AS (SELECT *, row_number() OVER w AS n,
        'p_' || coalesce(lag(event_type) OVER w, 'none') AS second FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      c AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS a1,
        second AS b1, ((floor(value)::BIGINT % 2 = 1) <> (n % 6 = 0)) AS swap FROM b),
      d AS (SELECT *, lag(CASE WHEN swap THEN b1 ELSE a1 END) OVER w AS sa,
        lag(CASE WHEN swap THEN a1 ELSE b1 END) OVER w AS sb FROM c
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT event_id, coalesce(sa, '-') AS slot_a, coalesce(sb, '-') AS slot_b FROM d""",
    "k11_interval_flag": """SELECT event_id, ((d, h) BETWEEN (2, 6) AND (5, 12)
      OR (d, h) BETWEEN (9, 0) AND (9, 23) OR (d, h) BETWEEN (20, 13) AND (21, 1))::BIGINT AS inside
      FROM (SELECT event_id, day(ts) AS d, hour(ts) AS h FROM events)""",
    "k15_group_hash": _K15,
    "k16_corpus_hash": digest_sql(f"({_K15})", "", "concat_ws(':', o_custkey, stream_hash)",
                                   "corpus_hash"),
}
