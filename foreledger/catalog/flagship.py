"""The flagship: causal state, forecast, proper scores, in one scan and one window."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreledger.catalog.base import EV_ORDER, day_chunk, table
from foreledger.functions import clip
from foreledger.operators.increments import causal_mean


def flagship_causal_score(spark, sf):
    """Forecast 'value above 50' from each user's own past, score it by event type."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    hit = F.when(F.col("value") > 50, 1.0).otherwise(0.0)
    p = clip(0.37 + F.col("theta"), 1e-15, 1 - 1e-15)
    y = F.col("y")
    s = causal_mean(e.withColumn("y", hit), F.col("y") - 0.37, ["user_id"], EV_ORDER, 25.0,
                    day_chunk()).withColumn("p", p)
    nll = -(y * F.log("p") + (1 - y) * F.log(1 - F.col("p")))
    return s.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(nll), 6).alias("nll"),
        F.round(F.avg(F.pow(F.col("p") - y, 2)), 6).alias("brier"))


QUERIES = {"flagship_causal_score": flagship_causal_score}
SQL = {"flagship_causal_score": """WITH b AS (SELECT *, (value > 50)::INT::DOUBLE AS y FROM events),
  c AS (SELECT *, least(greatest(0.37 + coalesce(sum(y - 0.37) OVER w, 0) / (count(*) OVER w + 25.0),
      1e-15), 1 - 1e-15) AS p FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT event_type, count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS nll,
    round(avg((p - y) * (p - y)), 6) AS brier FROM c GROUP BY event_type"""}
