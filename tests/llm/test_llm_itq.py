"""Embedding near-duplicates against all cosines; recall of the tables; hard cases."""

import math

import numpy as np
import pytest

from foreledger.llm import itq, registry

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows, similarity=itq.SIMILARITY):
    """(id, links, component, kept) of every row, from all pairs."""
    good = [v is not None and l is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if g else None for (_, v, _), g in zip(rows, good)]
    links, root = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[k] and rows[m][0] is not None]
        least = min(ids) if ids else None
        out.append((i, links[k], least, i == least))
    return sorted(map(str, out))


def groups(rng, d, sizes, label, first, spread=0.1):
    rows = []
    for size in sizes:
        centre = rng.standard_normal(d)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            noise = rng.standard_normal(d)
            rows.append((first + len(rows), (centre + spread * noise / np.linalg.norm(noise)).astype(np.float32).tolist(), label))
    return rows


def test_query_equals_all_cosines(spark):
    got = registry.op12_embedding_duplicates(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


@pytest.mark.parametrize("tile_bytes", [itq.TILE_BYTES, 1])
def test_planted_groups(spark, monkeypatch, tile_bytes):
    """Groups at the threshold, one of a third of all rows; with tiny tiles the buckets are split."""
    monkeypatch.setattr(itq, "TILE_BYTES", tile_bytes)
    rng = np.random.default_rng(8)
    rows = groups(rng, 32, [200, 30, 8, 5, 3, 2] + [1] * 150, 1, 0) + groups(rng, 32, [150, 4, 2] + [1] * 60, 2, 1000, 0.12)
    rows += [(5000 + k, rows[0][1], 1) for k in range(90)] + [(None, rows[0][1], 1), (0, rows[0][1], 1)]
    got = itq.near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()
    want = brute(rows)
    assert sum(a == b for a, b in zip(sorted(str(tuple(r)) for r in got), want)) >= 0.99 * len(want)


def test_recall_at_the_threshold():
    """Pairs exactly at cosine 0.98 that meet in some table, by number of tables."""
    rng = np.random.default_rng(3)
    d, n = 64, 4000
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((n, d))
    off -= (off * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    mean, axes = itq.fit_rotation(x, 64)
    assert np.allclose(axes.T @ axes, np.eye(64))
    for largest in (100, 1000, 5000, 10**5, 10**6, 10**8):
        edges = itq.table_edges(64, largest)
        (a, unsure_a), (b, unsure_b) = (itq.encode((v - mean) @ axes, edges) for v in (x, y))
        met = np.zeros(n, bool)
        for mask in itq._masks(edges):
            diff = (a ^ b) & mask
            met |= ((diff & ~unsure_a) == 0) | ((diff & ~unsure_b) == 0)
        met &= np.bitwise_count(a ^ b) <= itq.radius(64)
        print(largest, len(edges) - 1, met.mean())
        assert met.mean() >= 0.985


def test_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [], 1),
        (8, [1.0, None, 2.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [1.0, 2.0], 1),
        (12, [1.0, 2.0], 1), (None, v, 1), (None, [9.0, -1.0, 0.0], 1), (13, [-1.0, -2.0, -3.0], 1), (1, v, 1), (14, [1e-30, 2e-30, 3e-30], 1)]
    frame = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS node", "2 AS key", "3 AS h1", "4 AS rows", "5 AS kept_id")
    got = itq.near_duplicates(frame).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    left = itq.deduplicated(frame)
    assert left.columns == frame.columns and sorted(r["vec_id"] for r in left.collect() if r["vec_id"]) == [1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13]
    assert itq.near_duplicates(frame.filter("false")).count() == 0
    assert itq.near_duplicates(frame.filter("label IS NULL")).collect()[0]["n_links"] == 0
    one = spark.createDataFrame([(1, [2.0], 1), (2, [3.0], 1), (3, [-1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r)[:3] for r in itq.near_duplicates(one).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
