"""Registered queries: counts, dimensions, set checks, scalar functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreledger import functions as fn
from foreledger.catalog.base import (
    EVENT_CLASSES, LI_KEY, SQL_EVENT_SCORED, SQL_EVENTS, SQL_LINES, event_split, lines_split, orders_split,
    scored_events, table)
from foreledger.operators import census as C, metrics as M, tables as T
from foreledger.sources import integrity, sinks, tables as S
from foreledger.sources.stored import scratch_path


def scratch(spark) -> str:
    """A fresh folder on the shared folder of the session."""
    return scratch_path(spark, "scratch")


def a4_distinct_count(spark, sf):
    return C.distinct_values(lines_split(spark, sf), ["l_suppkey", "l_returnflag"], "temporal_split", 2).select(
        "l_suppkey", "l_returnflag", F.col("n_distinct"))


def a6_class_share(spark, sf):
    t = event_split(spark, sf).filter("temporal_split = 'train'")
    return C.class_shares(t, "event_type").withColumn("share", F.round("share", 12))


def a7_entity_dim(spark, sf):
    li = lines_split(spark, sf)
    names = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entity"), F.col("p_name").alias("name"))
    keyed = li.select("l_orderkey", F.col("l_partkey").cast("string").alias("entity")).dropDuplicates().join(names, "entity")
    d = C.entity_dimension(li, "l_orderkey", ["l_partkey", "l_suppkey"], "start_date", keyed)
    return d.select("entity", "name", "n_groups", F.col("first_seen").cast("string").alias("first_seen"),
                    F.col("last_seen").cast("string").alias("last_seen"))


def a9_crosstab_top10(spark, sf):
    return C.crosstab(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ("A", "N", "R"), top=10)


def a10_shape_census(spark, sf):
    o = table(spark, sf, "orders").withColumn("m", F.when(F.col("o_totalprice") > 300000, F.col("o_orderpriority")))
    return C.shape_census(o, {
        "status": fn.text_or(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), "(open)"),
        "method_set": F.col("m").isNotNull().cast("long"), "method": fn.text_or(F.col("m"), "-")})


def a19_dilution(spark, sf):
    li = lines_split(spark, sf).withColumn("who", F.when(F.col("l_discount") > 0.005, F.col("l_partkey")))
    train = li.filter("temporal_split = 'train'")
    r = T.attach_seen(li.filter("temporal_split = 'test'"), train, "who", "seen").withColumn("year", F.year("start_date"))
    d = C.dilution(r, {"null_share": F.col("who").isNull(), "unseen_share": ~F.col("seen") & F.col("who").isNotNull()}, ["year"])
    return d.select(F.col("year").cast("long").alias("year"), "n", F.round("null_share", 12).alias("null_share"),
                    F.round("unseen_share", 12).alias("unseen_share"))


def a20_distinct_groups(spark, sf):
    return C.distinct_groups(lines_split(spark, sf), ["temporal_split"], "l_orderkey")


def a25_grouped_means(spark, sf):
    s = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("v"))
    g = C.grouped_means(s, "event_type", {"passive": ("view", "click"), "active": ("purchase", "signup"), "fault": ("error",)}, ["v"])
    return g.select("group", F.round("v", 9).alias("v"))


def a26_value_shares(spark, sf):
    """Nats gained below the uniform forecast, layer by layer, with shares of the total."""
    k = len(EVENT_CLASSES)
    uni = F.array(*[F.lit(1.0 / k)] * k)
    s = scored_events(spark, sf).filter("temporal_split = 'train'").agg(
        F.avg(M.nll_multi(uni, F.col("y"))).alias("u"), F.avg(M.nll_multi(F.col("p0"), F.col("y"))).alias("m"),
        F.avg(M.nll_multi(F.col("p"), F.col("y"))).alias("b"))
    rows = F.array(F.struct(F.lit("marginal").alias("layer"), (F.col("u") - F.col("m")).alias("nats")),
                   F.struct(F.lit("band").alias("layer"), (F.col("m") - F.col("b")).alias("nats")))
    d = C.value_shares(s.select(F.explode(rows).alias("r")).select("r.*"), "layer", "nats")
    return d.select("layer", F.round("nats", 10).alias("nats"), F.round("share", 6).alias("share"))


def o1_ordered_output(spark, sf):
    return C.key_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


def o2_top10(spark, sf):
    c = C.class_shares(table(spark, sf, "lineitem").withColumn("part", F.col("l_partkey")), "part")
    return c.orderBy(F.desc("n"), "part").limit(10).select("part", "n")


def u1_distinct_pairs(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").dropDuplicates()


def u2_values_outside(spark, sf):
    return C.values_outside(table(spark, sf, "events"), "event_type", ("click", "view", "purchase"))


def u3_union_ids(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.explode(F.array("l_orderkey", "l_partkey", "l_suppkey")).alias("id")).distinct()


def u4_key_difference(spark, sf):
    """Keys of every props object outside and missing from a closed set."""
    e = table(spark, sf, "events").select(F.json_object_keys("props").alias("ks"))
    return e.groupBy(
        F.array_join(F.array_except("ks", F.array(F.lit("a"), F.lit("b"))), ",").alias("unknown"),
        F.array_join(F.array_except(F.array(F.lit("a"), F.lit("k")), F.col("ks")), ",").alias("missing"),
    ).agg(F.count(F.lit(1)).alias("n"))


def v1_unknown_keys(spark, sf):
    """Closed-world and type check of events.props: reason per distinct failure."""
    from foreledger.functions import variants as V
    from foreledger.operators import validate as VA

    k = F.try_element_at(V.as_object(F.col("v")), F.lit("k"))
    e = table(spark, sf, "events").select(F.parse_json("props").alias("v"), "event_type")
    bad = VA.first_of((V.not_int(k), "E_SCHEMA", "k: expected integer"),
                      (V.text(k).cast("int") > 95, "E_OTHER", "k above 95"))
    r = F.coalesce(VA.key_errors(V.as_object(F.col("v")), ("k", "z"), ("k",), "props"), bad)
    return e.select("event_type", r.alias("r")).groupBy(
        "event_type", F.coalesce("r.reason", F.lit("OK")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def f_scalar_functions(spark, sf):
    """Clip, logit, sigmoid, softmax, one-hot, dot, bits and date helpers on every line."""
    li = table(spark, sf, "lineitem")
    p = fn.clip(F.col("l_discount") * 5, 0.01, 0.6)
    z = F.array(F.col("l_tax") * 10, F.col("l_discount") * 10, F.lit(0.3))
    sm = fn.softmax(z)
    li = li.withColumns({"p": p, "sm": sm, "lg": fn.logit(p)})
    hot = fn.one_hot(F.col("l_linenumber") % 3, 3)
    return li.groupBy("l_returnflag", F.year(F.to_date("l_shipdate")).cast("long").alias("year")).agg(
        F.round(F.sum("lg"), 5).alias("lg"), F.round(F.sum(fn.sigmoid(F.col("lg"))), 5).alias("sg"),
        F.round(F.sum(fn.dot(F.col("sm"), hot)), 5).alias("sm"),
        F.round(F.sum(fn.nats_to_bits(F.col("p"))), 5).alias("bits"),
        F.round(F.sum(fn.safe_div(F.col("l_tax"), F.col("l_discount"))), 5).alias("ratio"),
        F.sum(fn.arg_max(F.col("sm"))).alias("argmax"))


def s2_parquet_scan(spark, sf):
    o = S.read_table(spark, f"{sf}/orders.parquet")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def s3_fact_round_trip(spark, sf):
    """Write the facts partitioned by split, read one partition back."""
    li = lines_split(spark, sf).select(*LI_KEY[:-1], "l_quantity", "temporal_split")
    path = scratch(spark)
    sinks.write_facts(li, path, li.schema)
    return S.read_table(spark, path).filter("temporal_split = 'val'").select(*LI_KEY[:-1], "l_quantity")


def s4_dimension_round_trip(spark, sf):
    o = orders_split(spark, sf).select("o_orderkey", "start_date", "temporal_split")
    path = scratch(spark)
    sinks.write_dimension(o, path, o.schema)
    back = S.read_table(spark, path, o.schema)
    return back.groupBy("temporal_split").agg(F.count(F.lit(1)).alias("n"))


def s5_quarantine_round_trip(spark, sf):
    """Reject cheap orders with a detail text that needs quoting; write and read the CSV."""
    o = table(spark, sf, "orders").filter("o_totalprice < 20000").select(
        F.col("o_orderkey").cast("string").alias("match_id"), F.lit("E_OTHER").alias("reason"),
        F.concat(F.lit('price "low", '), F.col("o_orderpriority")).alias("detail"))
    path = scratch(spark)
    sinks.write_quarantine(o, path)
    return S.read_quarantine(spark, path)


def s7_metrics_json(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    path = scratch(spark)
    sinks.write_metrics(m, path)
    return spark.read.schema("l_returnflag string, n long").json(path)


def s8_snapshot_integrity(spark, sf):
    """Compare every table file with a manifest in which one is altered, one missing and one too many."""
    d = integrity.file_digests(spark, sf, "*.parquet")
    listed = d.filter("file <> 'nation.parquet'").select("file", F.when(
        F.col("file") == "region.parquet", F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    ghost = spark.range(1).select(F.lit("ghost.parquet").alias("file"), F.lit("0").alias("sha256"))
    bad = integrity.snapshot_violations(d, listed.unionByName(ghost))
    return bad.select("file", F.when(F.col("actual").isNull(), "absent").when(
        F.col("expected").isNull(), "not listed").otherwise("altered").alias("fault"))


def v18_schema_contract(spark, sf):
    """Rows for every difference between a table and its declared contract."""
    golden = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "int", "event_type": "string", "value": "double"}
    diffs = integrity.schema_violations(table(spark, sf, "events"), golden)
    n = table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select("n_rows", F.explode(F.array(*[F.lit(d) for d in diffs])).alias("difference"))


QUERIES = {f.__name__: f for f in (
    a4_distinct_count, a6_class_share, a7_entity_dim, a9_crosstab_top10, a10_shape_census, a19_dilution,
    a20_distinct_groups, a25_grouped_means, a26_value_shares, o1_ordered_output, o2_top10, u1_distinct_pairs,
    u2_values_outside, u3_union_ids, u4_key_difference, v1_unknown_keys, f_scalar_functions, s2_parquet_scan,
    s3_fact_round_trip, s4_dimension_round_trip, s5_quarantine_round_trip, s7_metrics_json, s8_snapshot_integrity,
    v18_schema_contract)}

SQL = {
    "a4_distinct_count": f"""WITH {SQL_LINES} SELECT l_suppkey, l_returnflag, count(DISTINCT temporal_split) AS n_distinct
      FROM lines GROUP BY ALL HAVING count(DISTINCT temporal_split) > 2""",
    "a6_class_share": f"""WITH {SQL_EVENTS} SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 12) AS share
      FROM ev WHERE temporal_split = 'train' GROUP BY 1""",
    "a7_entity_dim": f"""WITH {SQL_LINES}, ids AS (SELECT l_orderkey, start_date, l_partkey AS id FROM lines
        UNION ALL SELECT l_orderkey, start_date, l_suppkey FROM lines),
      nm AS (SELECT DISTINCT l_orderkey, l_partkey AS id, p_name FROM lines JOIN part ON p_partkey = l_partkey)
      SELECT id::VARCHAR AS entity, min(coalesce(p_name, id::VARCHAR)) AS name, count(DISTINCT ids.l_orderkey) AS n_groups,
        min(start_date)::VARCHAR AS first_seen, max(start_date)::VARCHAR AS last_seen
      FROM ids LEFT JOIN nm USING (l_orderkey, id) GROUP BY id""",
    "a9_crosstab_top10": """SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N,
      count(*) FILTER (l_returnflag = 'R') AS R, count(*) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 10""",
    "a10_shape_census": """SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '(open)' END AS status,
      (o_totalprice > 300000)::BIGINT AS method_set, CASE WHEN o_totalprice > 300000 THEN o_orderpriority ELSE '-' END AS method,
      count(*) AS n FROM orders GROUP BY ALL""",
    "a19_dilution": f"""WITH {SQL_LINES}, li AS (SELECT *, CASE WHEN l_discount > 0.005 THEN l_partkey END AS who FROM lines),
      tr AS (SELECT DISTINCT who FROM li WHERE temporal_split = 'train' AND who IS NOT NULL)
      SELECT year(start_date) AS year, count(*) AS n, round(avg((li.who IS NULL)::INT), 12) AS null_share,
        round(avg((li.who IS NOT NULL AND tr.who IS NULL)::INT), 12) AS unseen_share
      FROM li LEFT JOIN tr ON li.who = tr.who WHERE temporal_split = 'test' GROUP BY 1""",
    "a20_distinct_groups": f"""WITH {SQL_LINES} SELECT temporal_split, count(DISTINCT l_orderkey) AS n_groups FROM lines GROUP BY 1""",
    "a25_grouped_means": """SELECT g AS "group", round(avg(v), 9) AS v FROM (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'passive'
      WHEN event_type = 'error' THEN 'fault' ELSE 'active' END AS g, avg(value) AS v FROM events GROUP BY event_type, 1) GROUP BY 1""",
    "a26_value_shares": f"""WITH {SQL_EVENT_SCORED}, s AS (SELECT avg(-ln(0.2)) - avg(-ln(p0[y + 1])) AS a,
        avg(-ln(p0[y + 1])) - avg(-ln(p[y + 1])) AS b FROM escored WHERE temporal_split = 'train')
      SELECT 'marginal' AS layer, round(a, 10) AS nats, round(a / (a + b), 6) AS share FROM s
      UNION ALL SELECT 'band', round(b, 10), round(b / (a + b), 6) FROM s""",
    "o1_ordered_output": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL",
    "o2_top10": "SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, part LIMIT 10",
    "u1_distinct_pairs": "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem",
    "u2_values_outside": "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')",
    "u3_union_ids": """SELECT l_orderkey AS id FROM lineitem UNION SELECT l_partkey FROM lineitem UNION SELECT l_suppkey FROM lineitem""",
    "u4_key_difference": """SELECT array_to_string(list_filter(json_keys(props), lambda x: x NOT IN ('a', 'b')), ',') AS unknown,
      array_to_string(list_filter(['a', 'k'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing, count(*) AS n
      FROM events GROUP BY ALL""",
    "v1_unknown_keys": """SELECT event_type, CASE WHEN json_extract_string(props, '$.k')::INT > 95 THEN 'E_OTHER' ELSE 'OK' END AS reason,
      count(*) AS n FROM events GROUP BY ALL""",
    "f_scalar_functions": """WITH a AS (SELECT *, least(greatest(l_discount * 5, 0.01), 0.6) AS p,
        [exp(l_tax * 10), exp(l_discount * 10), exp(0.3)] AS e, [l_tax * 10, l_discount * 10, 0.3] AS z FROM lineitem)
      SELECT l_returnflag, year(l_shipdate) AS year, round(sum(ln(p / (1 - p))), 5) AS lg, round(sum(p), 5) AS sg,
        round(sum(e[l_linenumber % 3 + 1] / list_sum(e)), 5) AS sm, round(sum(p / ln(2)), 5) AS bits,
        round(sum(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0 END), 5) AS ratio,
        sum(list_position(z, list_max(z)) - 1)::BIGINT AS argmax FROM a GROUP BY ALL""",
    "s2_parquet_scan": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "s3_fact_round_trip": f"""WITH {SQL_LINES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lines
      WHERE temporal_split = 'val'""",
    "s4_dimension_round_trip": f"WITH {SQL_LINES} SELECT temporal_split, count(*) AS n FROM o_split GROUP BY 1",
    "s5_quarantine_round_trip": """SELECT o_orderkey::VARCHAR AS match_id, 'E_OTHER' AS reason,
      'price "low", ' || o_orderpriority AS detail FROM orders WHERE o_totalprice < 20000""",
    "s7_metrics_json": "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1",
    "s8_snapshot_integrity": """SELECT * FROM (VALUES ('region.parquet', 'altered'), ('nation.parquet', 'not listed'),
      ('ghost.parquet', 'absent')) v(file, fault)""",
    "v18_schema_contract": """SELECT n_rows, difference FROM (SELECT count(*) AS n_rows FROM events),
      (VALUES ('unexpected column props'), ('user_id: expected int, got bigint')) v(difference)""",
}
