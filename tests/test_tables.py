"""Prefix-shrunk tables and the cuts of scored rows against plain Python."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from foreledger.operators import metrics as M
from foreledger.operators import tables as T

AXES = ["a", "b"]


def estimates(rows, tau):
    """Cell estimates by prefix, the parent's first."""
    sums = collections.defaultdict(lambda: [0, 0.0])
    for a, b, y in rows:
        for key in ((), (a,), (a, b)):
            sums[key][0] += 1
            sums[key][1] += y
    out = {}
    for key in sorted(sums, key=len):
        n, s = sums[key]
        out[key] = (s + tau * out[key[:-1]]) / (n + tau) if key else s / n
    return out


def test_prefix_lookup_over_wide_axes_needs_no_broadcast(spark):
    rng = random.Random(5)
    train = [(rng.randrange(3000), str(rng.randrange(40)), rng.randrange(2)) for _ in range(20_000)]
    asked = [(rng.choice([None, 1, 2, 9_999, rng.randrange(3000)]), rng.choice([None, "x", str(rng.randrange(40))]))
             for _ in range(4_000)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = spark.createDataFrame(train, "a int, b string, y int")
        levels = T.shrunk_levels(T.rollup_totals(frame, AXES, {"y": F.col("y")}), AXES, ["y"], 25.0)
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "i int, a bigint, b string")
        looked = T.prefix_lookup(df, levels, AXES, ["y"])
        assert "BroadcastHashJoin" not in looked._jdf.queryExecution().executedPlan().toString()
        got = {r["i"]: (r["found_depth"], r["e_y"]) for r in looked.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = estimates(train, 25.0)
    assert len(got) == len(asked)
    for i, (a, b) in enumerate(asked):
        key = next(k for k in ((a, b), (a,), ()) if k in known)
        assert got[i][0] == len(key) and got[i][1] == pytest.approx(known[key], abs=1e-12)


def test_breakdown_counts_overlapping_names_and_null_facets(spark):
    rows = [(0.2, 0, ["u", "v"], "x"), (0.7, 1, ["v"], "x"), (0.9, 0, [], "y"), (0.4, 1, None, "y")]
    df = spark.createDataFrame(rows, "p double, y int, names array<string>, k string")
    got = {(r["facet"], r["name"]): r for r in M.breakdown(
        df, ["p"], "y", 2, {"bucket": F.col("names"), "key": F.array("k")}).collect()}
    assert set(got) == {("bucket", "u"), ("bucket", "v"), ("key", "x"), ("key", "y")}
    want = collections.defaultdict(list)
    for p, y, names, k in rows:
        for cut in [("bucket", n) for n in names or []] + [("key", k)]:
            want[cut].append((p, y))
    for cut, seen in want.items():
        r = got[cut]
        assert r["n"] == len(seen)
        assert r["nll"] == pytest.approx(sum(-math.log(p if y else 1 - p) for p, y in seen) / len(seen))
        assert r["brier"] == pytest.approx(sum((p - y) ** 2 for p, y in seen) / len(seen))
        assert r["y_mean"] == pytest.approx(sum(y for _, y in seen) / len(seen))


def test_multiclass_rows_compare_the_top_label(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2], 0), ([0.5, 0.3, 0.2], 2), ([0.4, 0.4, 0.2], 0)], "q array<double>, y int")
    got = sorted((r["p"], r["hit"], round(r["nll"], 9)) for r in M.forecast_rows(df, ["q"], "y", 3).collect())
    assert got == sorted((p, h, round(-math.log(v), 9)) for p, h, v in ((0.5, 1.0, 0.5), (0.5, 0.0, 0.2), (0.4, 1.0, 0.4)))


def test_poison_differences_count_like_except_all_on_narrow_rows(spark):
    from foreledger.operators.guards import poison_differences

    kind = "a int, b double, c string"
    left = [(1, 0.0, "x"), (1, 0.0, "x"), (None, 1.0, "y"), (2, None, None), (3, 2.5, ""), (None, None, None)]
    right = [(1, -0.0, "x"), (2, 1.0, "y"), (2, None, None), (2, None, None), (3, 2.5, None), (None, None, None)]
    a, b = (spark.createDataFrame(r, kind) for r in (left, right))
    got = {r["side"]: r["n"] for r in poison_differences(a, b).collect()}
    assert got == {"clean": a.exceptAll(b).count(), "dirty": b.exceptAll(a).count()} == {"clean": 3, "dirty": 3}
    assert [r["n"] for r in poison_differences(a.limit(0), b.limit(0)).collect()] == [0, 0]
    plan = poison_differences(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "replicate" not in plan.lower()
    with pytest.raises(ValueError):
        poison_differences(a, b.withColumn("leak", F.lit(1)))


def test_entity_dimension_groups_ids_and_names_once(spark):
    from foreledger.operators.census import entity_dimension

    rows = [(1, "2024-01-02", 7, 8), (1, "2024-01-01", 7, None), (2, "2024-02-01", 8, 7), (None, "2023-01-01", 9, 9)]
    df = spark.createDataFrame(rows, "g long, d string, a long, b long").withColumn("d", F.to_date("d"))
    names = spark.createDataFrame([(1, "7", "Ann"), (1, "7", "Ada"), (3, "7", "A"), (None, "9", "A"), (2, "5", "A")], "g long, entity string, name string")
    dim = entity_dimension(df, "g", ["a", "b"], "d", names)
    assert {r["entity"]: (r["name"], r["n_groups"], str(r["first_seen"]), str(r["last_seen"])) for r in dim.collect()} == {
        "7": ("7", 2, "2024-01-01", "2024-02-01"), "8": ("8", 2, "2024-01-02", "2024-02-01"), "9": ("9", 1, "2023-01-01", "2023-01-01")}
    assert "Join" not in dim._jdf.queryExecution().executedPlan().toString()


def test_facet_calibration_reads_its_rows_once(spark, tmp_path):
    rows = [(i % 97 / 97, int(i % 3 == 0), "ab"[i % 2]) for i in range(600)]
    spark.createDataFrame(rows, "p double, y int, name string").write.parquet(f"{tmp_path}/rows")
    t = M.facet_calibration(spark.read.parquet(f"{tmp_path}/rows"), ["p"], "y", 2, F.array("name", F.lit("all")))
    assert not [f for f in t.inputFiles() if str(tmp_path) in f]
    assert {r["name"] for r in t.collect()} == {"a", "b", "all"}


def test_long_files_are_hashed_as_they_are_read(spark, tmp_path, monkeypatch):
    import hashlib

    from foreledger.sources import integrity

    mark, noise = b"\xef\xbb\xbf", random.Random(1).randbytes(400_000)
    files = {
        "noise": noise, "noise + end": noise + b"\n", "lines": b"\n" * 5000, "one line": b"0" * 9000, "crlf": b"\r\n\r" * 3000,
        "mark": mark + noise[:3000], "marked lines": mark + noise[:3000] + b"\n\n", "marks": (mark + b"\n") * 2000,
        "packed.gz": noise[:5000], "short": b"x", "at the limit": noise[:1000], "above it": noise[:1001]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(integrity, "WHOLE_BYTES", 1000)
    # As if a value could be no longer than that: nothing long may be read as one.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "6000")
    try:
        got = {r.file: (r.length, r.sha256) for r in integrity.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
