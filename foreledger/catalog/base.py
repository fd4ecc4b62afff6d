"""Shared inputs of the registered queries, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreledger.operators.splits import assign_split, temporal_bounds

LI_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
LI_KEY = ["l_orderkey", *LI_ORDER]
EV_ORDER = ["ts", "event_id"]
# Class order of the two label alphabets.
EVENT_CLASSES = ("click", "error", "purchase", "signup", "view")
FLAG_CLASSES = ("A", "N", "R")
# Valence of each event class, used by the latent queries.
EVENT_VALENCE = (1.0, 0.0, 6.0, 2.0, 3.0)
VALUE_EDGES = (10.0, 30.0, 60.0, 100.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day_chunk() -> list[Column]:
    """Scan chunks of the events table: one calendar day."""
    return [F.to_date("ts")]


def line_chunk() -> list[Column]:
    """Scan chunks inside an order: line number, then a stride of part keys."""
    return [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 65536)]


def bounds(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    return temporal_bounds(o, "d")


def orders_split(spark, sf, *cols: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("start_date"), *cols
    )
    return assign_split(o, "start_date", bounds(spark, sf))


def lines_split(spark, sf, *order_cols: str) -> DataFrame:
    """lineitem with its order's date and split: one join on the order key."""
    o = orders_split(spark, sf, *order_cols)
    return table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop(
        "o_orderkey"
    )


def rounded(p: Column, digits: int = 6) -> Column:
    return F.round(p, digits)


def frozen_score() -> Column:
    """A fixed logistic score of lineitem columns, rounded so engines agree."""
    z = (
        -0.7 + 0.01 * (F.col("l_quantity") - 25.0) - 2.0 * (F.col("l_discount") - 0.05)
        + 3.0 * (F.col("l_tax") - 0.04)
    )
    return rounded(1.0 / (1.0 + F.exp(-z)))


def scored_lines(spark, sf) -> DataFrame:
    """Binary scored rows: y = returned, p = fixed score, p0 = constant baseline."""
    return lines_split(spark, sf).select(
        *LI_KEY, "l_quantity", "l_discount", "l_tax", "l_linestatus", "start_date",
        "temporal_split", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        frozen_score().alias("p"), F.lit(0.33).alias("p0"),
    )


SQL_BOUNDS = """
o_days AS (SELECT CAST(o_orderdate AS DATE) AS d,
    row_number() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS i, count(*) OVER () AS n
  FROM orders),
bounds AS (SELECT min(CASE WHEN i = CAST(floor(n * 0.8) AS BIGINT) THEN d END) AS b1,
    min(CASE WHEN i = CAST(floor(n * 0.9) AS BIGINT) THEN d END) AS b2 FROM o_days),
o_split AS (SELECT o.*, CAST(o_orderdate AS DATE) AS start_date,
    CASE WHEN CAST(o_orderdate AS DATE) < b1 THEN 'train'
         WHEN CAST(o_orderdate AS DATE) < b2 THEN 'val' ELSE 'test' END AS temporal_split
  FROM orders o, bounds)"""

SQL_LINES = SQL_BOUNDS + """,
lines AS (SELECT l.*, o_custkey, o_orderstatus, o_orderpriority, start_date, temporal_split
  FROM lineitem l JOIN o_split ON l_orderkey = o_orderkey)"""

SQL_SCORED = SQL_LINES + """,
scored AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    round(1.0 / (1.0 + exp(-(-0.7 + 0.01 * (l_quantity - 25.0) - 2.0 * (l_discount - 0.05)
      + 3.0 * (l_tax - 0.04)))), 6) AS p, CAST(0.33 AS DOUBLE) AS p0 FROM lines)"""


def event_class_index() -> Column:
    c = F.lit(None)
    for i, k in reversed(list(enumerate(EVENT_CLASSES))):
        c = F.when(F.col("event_type") == k, i).otherwise(c)
    return c


SQL_CLASS_INDEX = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {i}" for i, k in enumerate(EVENT_CLASSES)
) + " END"


def event_split(spark, sf) -> DataFrame:
    """events with class index, value band and a split by event day."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    b = temporal_bounds(e, "day")
    from foreledger.functions import band_right

    return assign_split(e, "day", b).withColumns({
        "y": event_class_index(), "band": band_right(F.col("value"), VALUE_EDGES),
    })


SQL_EVENTS = f"""
e_days AS (SELECT CAST(ts AS DATE) AS d, row_number() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS i,
    count(*) OVER () AS n FROM events),
e_bounds AS (SELECT min(CASE WHEN i = CAST(floor(n * 0.8) AS BIGINT) THEN d END) AS b1,
    min(CASE WHEN i = CAST(floor(n * 0.9) AS BIGINT) THEN d END) AS b2 FROM e_days),
ev AS (SELECT e.*, CAST(ts AS DATE) AS day, {SQL_CLASS_INDEX} AS y,
    (value >= 10)::INT + (value >= 30)::INT + (value >= 60)::INT + (value >= 100)::INT AS band,
    CASE WHEN CAST(ts AS DATE) < b1 THEN 'train' WHEN CAST(ts AS DATE) < b2 THEN 'val'
      ELSE 'test' END AS temporal_split
  FROM events e, e_bounds)"""

# Class probabilities per value band from the train split, shrunk to the
# add-one marginal with 50 pseudo-events; k is 0-based, lists are 1-based.
SQL_EVENT_SCORED = SQL_EVENTS + """,
cls AS (SELECT unnest(range(5)) AS k),
marg AS (SELECT k, (count(y) + 1.0) / ((SELECT count(*) FROM ev WHERE temporal_split = 'train') + 5)
    AS pbar FROM cls LEFT JOIN (SELECT y FROM ev WHERE temporal_split = 'train') ON y = k GROUP BY k),
bt AS (SELECT band, k, count(*) FILTER (y = k) AS n, count(*) AS nb FROM ev, cls
    WHERE temporal_split = 'train' GROUP BY band, k),
bp AS (SELECT band, list((n + 50.0 * pbar) / (nb + 50.0) ORDER BY k) AS p
    FROM bt JOIN marg USING (k) GROUP BY band),
mp AS (SELECT list(pbar ORDER BY k) AS pm FROM marg),
escored AS (SELECT ev.*, bp.p, mp.pm AS p0 FROM ev JOIN bp USING (band), mp)"""


def event_marginal(ev: DataFrame) -> DataFrame:
    from foreledger.operators.tables import laplace_marginal

    return laplace_marginal(ev.filter("temporal_split = 'train'"), "y", len(EVENT_CLASSES))


def scored_events(spark, sf) -> DataFrame:
    """Five-class scored rows: p = shrunk band table, p0 = marginal."""
    from foreledger.operators.tables import class_table

    ev = event_split(spark, sf)
    train = ev.filter("temporal_split = 'train'")
    marg = event_marginal(ev)
    tab = class_table(train, ["band"], "y", len(EVENT_CLASSES), tau=50.0, prior=marg)
    p0 = marg.select("probs").scalar()
    return ev.join(F.broadcast(tab), "band").withColumn("p0", p0)
