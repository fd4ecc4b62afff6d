"""Run registered queries beside their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def make_spark(name="foreledger-tests", parallelism="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName(name)
        .config("spark.sql.shuffle.partitions", parallelism).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=key)


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(a - b) <= 1e-9 * max(1.0, abs(a))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    got = df.collect()
    cols, mine = rows_of(df.columns, [tuple(r) for r in got])
    if sql is None:
        return f"rows-only {len(mine)}" if mine else "EMPTY (rows-only)", bool(mine)
    res = con.execute(sql)
    rcols, theirs = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != rcols:
        return f"COLUMNS {cols} != {rcols}", False
    if len(mine) != len(theirs):
        return f"ROWS {len(mine)} != {len(theirs)}\n  {mine[:3]}\n  {theirs[:3]}", False
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if not all(close(x, y) for x, y in zip(a, b))]
        if bad:
            return f"VALUES differ in {len(bad)} of {len(mine)}: {bad[0]}", False
        return f"ok~ {len(mine)} (float tail)", True
    return f"ok {len(mine)}", True


def types_differ(spark, con, sf_dir, query, sql):
    a = {k: str(v) for k, v in query(spark, sf_dir).toPandas().dtypes.items()}
    b = {k: str(v) for k, v in con.execute(sql).df().dtypes.items()}
    return {k: (a[k], b.get(k)) for k in a if a[k] != b.get(k)}


def main(patterns, sf="0.01"):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    spark = make_spark()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), []
    for name, q in entry.queries().items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        t0 = time.time()
        try:
            msg, ok = compare(spark, con, sf_dir, name, q, sqls.get(name))
            if ok and os.environ.get("TYPES") and name in sqls:
                diff = types_differ(spark, con, sf_dir, q, sqls[name])
                msg += f"  TYPES {diff}" if diff else ""
        except Exception as exc:  # noqa: BLE001
            msg, ok = f"ERROR {type(exc).__name__}: {str(exc)[:900]}", False
        if not ok:
            bad.append(name)
        print(f"{name:28s} {time.time() - t0:6.2f}s  {msg}", flush=True)
    print("FAILED:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:], os.environ.get("SF", "0.01"))
