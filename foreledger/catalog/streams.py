"""Registered queries that run the events table as a stream."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from foreledger.catalog.base import table
from foreledger.catalog.census import scratch
from foreledger.catalog.documents import _FOLD, _X, documents, shown
from foreledger.operators import events as E, splits
from foreledger.plans import corpus
from foreledger.sources.stored import stored
from foreledger.streaming import documents as SD, fold as SF
from foreledger.streaming.innings import stream_innings

# Events that the stream brings again at its end.
RESENT = "event_id % 97 = 0"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


SLICES, FILES = 4, 8


#: Keyed state in RocksDB; without empty micro-batches, which timers of processing time ask for without end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def _keyed_state(spark):
    """The session's own settings come back."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _fed(spark, slices, path, key):
    """A stream whose micro-batches are the given frames; a frame has each key in one file.

    Spark writes no file for an empty partition, so empty files make up the number.
    """
    schema = slices[0].schema
    none = spark.createDataFrame([], schema).coalesce(1)
    for part in slices:
        part.repartition(FILES, key).write.mode("append").parquet(path)
        for _ in range(-len(spark.read.schema(schema).parquet(path).inputFiles()) % FILES):
            none.write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(path)


def _stream(spark, sf, base):
    """All events by rising time, those without a time first; some come a second time, late."""
    e = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.min(micros), F.max(micros)).first()
    part = F.coalesce(F.least(F.floor((micros - lo) * SLICES / F.lit((hi or 0) - (lo or 0) + 1)), F.lit(SLICES - 1)), F.lit(-1))
    slices = [e.filter(part == k) for k in range(-1, SLICES)] + [e.filter(RESENT)]
    return _fed(spark, slices, f"{base}/in", "user_id")


def _folded(spark, sf):
    """Fold the stream into Parquet, then hand back the batch view of the sink."""
    base = scratch(spark)
    with _keyed_state(spark):
        at = F.coalesce(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lit(""))
        order = F.concat(at, F.lpad(F.col("event_id").cast("string"), 20, "0"))
        f = SF.stream_fold(
            _stream(spark, sf, base), "user_id", order, value=F.col("value"), legal=F.col("event_type") != "signup",
            fall=F.col("event_type") == "error", signal=F.round(F.col("value") * 100), keep=["event_id"])
        SF.drain_to(f, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


def st1_stream_fold(spark, sf):
    f = _folded(spark, sf)
    return f.select("event_id", F.round("score", 4).alias("runs"), F.col("legal_count").alias("legal_balls"),
                    F.col("falls").alias("wickets"), F.round("since_fall", 4).alias("partnership_runs"),
                    F.col("late").cast("long").alias("late"))


def st2_stream_mean(spark, sf):
    f = SF.stream_causal_mean(_folded(spark, sf), 25.0)
    return f.select("event_id", "n_before", (F.col("theta") / 100).alias("theta"))


def st3_stream_quarantine(spark, sf):
    base = scratch(spark)
    reason = F.when(F.col("event_type") == "error", "E_OTHER").when(F.col("value") > 200, "E_SCHEMA")
    q = SF.route_stream(
        _stream(spark, sf, base), reason, SF.replace_epoch(f"{base}/good"), SF.replace_epoch(f"{base}/bad"),
        f"{base}/ckpt")
    q.awaitTermination()
    good = spark.read.parquet(f"{base}/good").select(F.lit("OK").alias("reason"), "value")
    bad = spark.read.parquet(f"{base}/bad").select("reason", "value")
    return good.unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


_INNINGS_STATE = (
    "legal_balls", "runs", "wickets", "partnership_runs", "partnership_balls", "fow_last_runs", "fow_last_ball",
    "bowler_legal_balls", "bowler_runs_conceded", "bowler_wickets", "striker_runs", "striker_balls", "non_striker_runs",
    "non_striker_balls", "last_ball_was_noball")


def st1_stream_innings(spark, sf):
    """State before every delivery of a stream of deliveries, up to an innings' first broken rule.

    Every innings is cut over micro-batches; some deliveries come a second time, late.
    """
    base = scratch(spark)
    flat = stored(E.flatten(E.checked_documents(documents(spark, sf)).filter("error is null")))
    part = F.least(F.floor(F.col("over_pos") / 5), F.lit(SLICES - 1))
    slices = [flat.filter(part == k) for k in range(SLICES)] + [flat.filter("over_pos % 7 = 2 AND ball_in_over = 3")]
    with _keyed_state(spark):
        SF.drain_to(stream_innings(_fed(spark, slices, f"{base}/in", "match_id")), f"{base}/out", f"{base}/ckpt")
    s = spark.read.parquet(f"{base}/out")
    return s.select(
        shown(), *[F.col(c).cast("long").alias(c) for c in ("innings_idx", "over_pos", "ball_in_over")],
        *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in _INNINGS_STATE],
        *[F.coalesce(c, F.lit("-")).alias(c) for c in ("striker_id", "non_striker_id", "bowler_id", "reason")],
        F.col("late").cast("long").alias("late"))


def st3_stream_documents(spark, sf):
    """A folder of documents built as a stream that is stopped, fed again and restarted.

    Half of the documents come before the stop; the rest and every seventh of the first
    half again come after it.
    """
    base = scratch(spark)
    docs = stored(documents(spark, sf).withColumn("m", F.substring("match_id", 2, 20).cast("long")))
    bounds = stored(splits.temporal_bounds(corpus.scope_dates(docs), "start_date"))
    early = F.col("m") % 2 == 0
    with _keyed_state(spark):
        for sent in (docs.filter(early), docs.filter(~early | (F.col("m") % 7 == 0))):
            sent.select("raw", "match_id").write.mode("append").partitionBy("match_id").text(f"{base}/in")
            SD.route_documents(SD.read_document_stream(spark, f"{base}/in"), bounds, f"{base}/out", f"{base}/ckpt").awaitTermination()
    facts, bad = (spark.read.parquet(f"{base}/out/{t}") for t in ("facts", "quarantine"))
    good = facts.groupBy("match_id").agg(F.lit("OK").alias("reason"), F.count("*").alias("n"))
    return good.unionByName(bad.select("match_id", "reason", F.lit(0).cast("long").alias("n"))).withColumn("match_id", shown())


_ERRORS = "(SELECT m, i, min(b) AS eb, arg_min(reason, b) AS er FROM ball_err WHERE reason IS NOT NULL GROUP BY m, i)"
_UPTO = f"""
upto AS (SELECT sound.*, CASE WHEN b = eb THEN er END AS reason FROM sound LEFT JOIN {_ERRORS} USING (m, i)
  WHERE eb IS NULL OR b <= eb),"""
_STREAMED = _X + "," + _UPTO + _FOLD.removeprefix(_X + ",").replace("FROM ok", "FROM upto")

QUERIES = {f.__name__: f for f in (
    st1_stream_fold, st1_stream_innings, st2_stream_mean, st3_stream_quarantine, st3_stream_documents)}
SQL = {
    "st1_stream_innings": f"""WITH {_STREAMED} SELECT match_id, i + 1 AS innings_idx, ov::BIGINT AS over_pos, k AS ball_in_over,
      lb AS legal_balls, runs, wk AS wickets,
      (runs - CASE WHEN m % 16 = 3 THEN 5 ELSE 0 END - coalesce(fr, 0))::BIGINT AS partnership_runs, (lb - coalesce(fl, 0))::BIGINT AS partnership_balls,
      coalesce(fr + CASE WHEN m % 16 = 3 THEN 5 ELSE 0 END, -1)::BIGINT AS fow_last_runs, coalesce(fl, -1)::BIGINT AS fow_last_ball,
      (CASE WHEN bn = 1 AND pb IS NOT NULL THEN pbl ELSE bl - legal END)::BIGINT AS bowler_legal_balls,
      (CASE WHEN bn = 1 AND pb IS NOT NULL THEN pbc ELSE bc - bat - wides - noballs END)::BIGINT AS bowler_runs_conceded,
      (CASE WHEN bn = 1 AND pb IS NOT NULL THEN pbk ELSE bk - cred END)::BIGINT AS bowler_wickets,
      coalesce(CASE WHEN st = 'P0' THEN r0 WHEN st IS NOT NULL THEN lr END, -1)::BIGINT AS striker_runs,
      coalesce(CASE WHEN st = 'P0' THEN b0 WHEN st IS NOT NULL THEN lbl END, -1)::BIGINT AS striker_balls,
      coalesce(CASE WHEN nst = 'P0' THEN r0 WHEN nst IS NOT NULL THEN lr END, -1)::BIGINT AS non_striker_runs,
      coalesce(CASE WHEN nst = 'P0' THEN b0 WHEN nst IS NOT NULL THEN lbl END, -1)::BIGINT AS non_striker_balls,
      coalesce(pnb, false)::BIGINT AS last_ball_was_noball, coalesce('id' || st, '-') AS striker_id, coalesce('id' || nst, '-') AS non_striker_id,
      'id' || CASE WHEN bn = 1 AND pb IS NOT NULL THEN pb ELSE bowler END AS bowler_id, coalesce(reason, '-') AS reason, 0::BIGINT AS late FROM f4
      UNION ALL SELECT match_id, i + 1, ov, k, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, '-', '-', '-', '-', 1 FROM sound
      WHERE ov % 7 = 2 AND k = 3""",
    "st3_stream_documents": f"""WITH {_X} SELECT match_id, 'OK' AS reason, count(*) AS n FROM ok GROUP BY match_id
      UNION ALL SELECT match_id, reason, 0 FROM q WHERE reason IS NOT NULL""",
    "st1_stream_fold": """WITH a AS (SELECT *, (event_type <> 'signup')::INT AS l, (event_type = 'error')::INT AS e,
        sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) - (event_type = 'error')::INT AS isl FROM events),
      done AS (SELECT user_id, sum(value) AS v, sum(l) AS l, sum(e) AS e,
        sum(value) FILTER (e = 0 AND isl = tops) AS since FROM (SELECT *, sum(e) OVER (PARTITION BY user_id) AS tops FROM a) GROUP BY user_id)
      SELECT event_id, round(v, 4) AS runs, d.l::BIGINT AS legal_balls, d.e::BIGINT AS wickets,
        round(coalesce(since, 0), 4) AS partnership_runs, 1::BIGINT AS late FROM events JOIN done d USING (user_id) WHERE event_id % 97 = 0
      UNION ALL
      SELECT event_id, round(coalesce(sum(value) OVER w, 0), 4) AS runs, coalesce(sum(l) OVER w, 0)::BIGINT AS legal_balls,
        coalesce(sum(e) OVER w, 0)::BIGINT AS wickets, round(coalesce(sum(value) OVER p, 0), 4) AS partnership_runs, 0::BIGINT AS late FROM a
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        p AS (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "st2_stream_mean": """SELECT event_id, count(*) OVER u AS n_before,
      sum(round(value * 100)) OVER u / (count(*) OVER u + 25.0) / 100 AS theta FROM events
      WINDOW u AS (PARTITION BY user_id) QUALIFY event_id % 97 = 0
      UNION ALL SELECT event_id, count(*) OVER w AS n_before,
      coalesce(sum(round(value * 100)) OVER w, 0) / (count(*) OVER w + 25.0) / 100 AS theta FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "st3_stream_quarantine": """SELECT CASE WHEN event_type = 'error' THEN 'E_OTHER' WHEN value > 200 THEN 'E_SCHEMA' ELSE 'OK' END AS reason,
      count(*) AS n, round(sum(value), 2) AS total
      FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 97 = 0) GROUP BY 1""",
}
