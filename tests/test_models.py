"""Fitted parts: temperatures at a bound, boosting that grows on, the identity gate."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from foreledger.operators import calibrate as C
from foreledger.operators import metrics
from foreledger.operators import models as MO
from foreledger.plans import increment


def nll(rows, t):
    total = 0.0
    for z, y in rows:
        top = max(x / t for x in z)
        total += top + math.log(sum(math.exp(x / t - top) for x in z)) - z[y] / t
    return total / len(rows)


@pytest.mark.parametrize("kind", ["noise", "sure", "inside"])
def test_temperature_is_least_and_reaches_its_bounds(spark, kind):
    rng, rows = random.Random(4), []
    for _ in range(400):
        z = [rng.gauss(0, 2) for _ in range(3)]
        best = max(range(3), key=z.__getitem__)
        y = {"noise": rng.randrange(3), "sure": best, "inside": best if rng.random() < 0.6 else rng.randrange(3)}[kind]
        rows.append((z, min(range(3), key=z.__getitem__) if kind == "noise" else y))
    frame = spark.createDataFrame(rows, "z array<double>, y int")
    t, = C.fit_temperatures(frame, [F.col("z")], "y")
    assert t == {"noise": C.T_BOUNDS[1], "sure": C.T_BOUNDS[0]}.get(kind, t)
    grid = [C.T_BOUNDS[0] * (C.T_BOUNDS[1] / C.T_BOUNDS[0]) ** (k / 200) for k in range(201)]
    assert nll(rows, t) <= min(nll(rows, g) for g in grid) + 1e-12


def boosted_frame(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = rng.random(), rng.random()
        p = 0.85 if (a > 0.5) != (b > 0.5) else 0.15
        rows.append((a, b, 1.0 if rng.random() < p else -1.0))
    df = spark.createDataFrame(rows, "a double, b double, __s double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="__x").transform(df)


def test_boosting_grows_on_and_is_cut_at_the_best_step(spark):
    train, val = boosted_frame(spark, 1500, 1), boosted_frame(spark, 800, 2)
    grow = lambda n, patience: MO.grow_boosted(train, val, n, 2, patience, 3, 20, 7, rate=0.5)
    trees, weights, scores = grow(14, 2)
    watch = MO._Patience()
    for k, s in enumerate(scores, 1):
        assert watch.stale < 2
        watch.saw(2 * k, s)
    assert len(trees) == len(weights) == watch.step and scores[0] < math.log(2)
    kept = MO._with_margin(val.withColumn("__f", F.lit(0.0)), trees, weights)
    loss = kept.agg(F.avg(F.log1p(F.exp(-2 * F.col("__s") * F.col("__f"))))).first()[0]
    assert abs(loss - min(scores)) < 1e-6
    # Eight rounds at once, and four that go on from stored margins.
    whole, parts = grow(8, 9), grow(8, 1)
    assert len(whole[2]) == 4 and all(abs(a - b) < 1e-6 for a, b in zip(whole[2], parts[2]))


def test_alike_rows_are_fitted_as_one_with_their_weight(spark):
    """Trees of rows that stand for several equal trees of the copies; leaves count rows, not kinds of rows."""
    train, val = boosted_frame(spark, 300, 1), boosted_frame(spark, 200, 2)
    thrice = train.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("k")
    grow = lambda d: MO.grow_boosted(d, val, 6, 2, 1, 3, 60, 7, rate=0.5)[2]
    copies, weighted = grow(thrice), grow(train.withColumn("__w", F.lit(3.0)))
    assert len(copies) == len(weighted) and all(abs(a - b) < 1e-9 for a, b in zip(copies, weighted))
    assert all(abs(a - b) < 1e-9 for a, b in zip(weighted, grow(MO.alike(thrice, ["__x"], "__s"))))


def test_boosted_probabilities(spark):
    train, val = (boosted_frame(spark, n, s).withColumn("y", (F.col("__s") > 0).cast("int")).drop("__x", "__s") for n, s in ((1500, 1), (500, 2)))
    m = MO.fit_boosted(train, val, "y", 2, ["a", "b"], max_rounds=6, step=3, max_depth=3)
    got = m.predict(val, "p")
    assert got.columns == ["a", "b", "y", "p"]
    assert MO.mean_nll(got, "p", "y", 2) < 0.6 and got.filter("p <= 0 OR p >= 1").count() == 0


def test_identity_gate_finds_planted_effects(spark):
    rng, rows = random.Random(3), []
    for k in range(6000):
        user = rng.randrange(40)
        y = 0 if rng.random() < (0.7 if user % 2 else 0.3) else 1
        rows.append((k, user, user % 3, y, [0.5, 0.5], ("train", "val", "test")[k % 3]))
    df = spark.createDataFrame(rows, "event_id long, user_id int, hour int, y int, base array<double>, s string")
    parts = [df.filter(F.col("s") == s).drop("s") for s in ("train", "val", "test")]
    gate = increment.identity_gate(*parts, k=2, entities=["user_id", "hour"], key=["event_id"], group="user_id", grid=(10.0, 50.0), n_boot=200)
    v = gate["verdict"].first()
    assert v["verdict"] == "JUSTIFIES_TOWER" and v["point"] < -0.05 and v["hi"] < 0
    assert gate["dilution"].count() > 0 and gate["curve"].count() == 2


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "steps"])
def test_isotonic_pools_merge_over_ranges(spark, shape):
    """Pools of many small ranges, and the applied map, against pooling in one list."""
    rng, rows = random.Random(6), {}
    for k in range(3000):
        x = round(rng.random(), 3)
        p = {"noise": 0.2 + 0.6 * x, "falling": 0.9 - 0.8 * x, "rising": float(x > 0.5), "steps": 0.1 + 0.4 * (int(x * 4) % 3)}[shape]
        s, w = rows.get(x, (0, 0))
        rows[x] = (s + (rng.random() < p), w + 1)
    pools = []
    for x, (s, w) in sorted(rows.items()):
        pools.append([x, x, s, w])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, s1, w1 = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + s1, pools[-1][3] + w1]
    points = spark.createDataFrame([(x, s, w) for x, (s, w) in rows.items()] + [(None, 1, 1)], "x double, s int, w int")
    for size in (40, 10**6):
        blocks = C.isotonic_blocks(points, size)
        got = sorted((r["lo"], r["hi"], round(r["value"], 12)) for r in blocks.collect())
        assert got == [(a, b, round(s / w, 12)) for a, b, s, w in pools]
    ask = [-1.0, 2.0, *[k / 997 for k in range(997)], pools[0][0]]
    value = lambda b: min(max(b[2] / b[3], C.EPS), 1 - C.EPS)

    def at(x):
        below = [b for b in pools if b[0] <= x]
        above = [b for b in pools if b[0] > x]
        if not below or not above or x <= below[-1][1]:
            return value(below[-1] if below else above[0])
        a, b = below[-1], above[0]
        raw = a[2] / a[3] + (x - a[1]) / (b[0] - a[1]) * (b[2] / b[3] - a[2] / a[3])
        return min(max(raw, C.EPS), 1 - C.EPS)

    asked = spark.createDataFrame([(x,) for x in ask] + [(None,)], "p double")
    found = C.apply_isotonic(asked, "p", blocks, "c").collect()
    assert len(found) == len(ask) + 1
    assert all(r["c"] is None if r["p"] is None else abs(r["c"] - at(r["p"])) < 1e-9 for r in found)


def test_hash_trees_name_changed_keys(spark):
    from foreledger.operators import digest

    rows = [(k, k % 7, f"v{k}") for k in range(500)] + [(None, 1, "x")]
    a = spark.createDataFrame(rows, "k int, g int, v string")
    changed = [(k, g, "other" if k == 17 else v) for k, g, v in rows if k != 33] + [(44, 2, "v44"), (900, 1, "new")]
    b = spark.createDataFrame(changed[::-1], "k int, g int, v string")
    got = {r["k"]: (r["n_a"], r["n_b"]) for r in digest.differing_keys(a, b, ["k"], ["k", "g", "v"], 2).collect()}
    assert got == {17: (1, 1), 33: (1, 0), 44: (1, 2), 900: (0, 1)}
    tree = lambda d: digest.hash_tree(d, ["k"], ["k", "g", "v"], 2)
    assert digest.tree_differences(tree(a), tree(a.orderBy("v"))).count() == 0
    apart = digest.tree_differences(tree(a), tree(b)).collect()
    assert sum(r["level"] == 0 for r in apart) == 1 and 1 < len(apart) <= 9


def test_the_gate_fits_the_arms_in_common_passes(spark, monkeypatch):
    """One search for the strengths and one for all four arms, not one an arm."""
    from foreledger.operators import calibrate
    from foreledger.plans import increment

    asked, plain = [], calibrate.fit_temperatures
    monkeypatch.setattr(calibrate, "fit_temperatures", lambda rows, logits, y: asked.append(len(logits)) or plain(rows, logits, y))
    rows = spark.range(120).selectExpr(
        "id AS event_id", "id % 7 AS user_id", "cast(xxhash64(id) % 2 = 0 AS int) AS y", "array(0.4D, 0.6D) AS base")
    gate = increment.identity_gate(*[rows.filter(f"event_id % 3 = {k}") for k in range(3)], k=2, entities=["user_id"],
                                   key=["event_id"], group="user_id", grid=(10.0, 50.0), n_boot=20)
    assert gate["verdict"].count() == 1 and asked == [2, 4]


def test_a_cell_scores_alike_rows_once_with_their_number(spark, monkeypatch):
    from foreledger.plans import leaderboard

    rng, rows = random.Random(8), []
    for k in range(240):
        a, b = float(rng.randrange(4)), float(rng.randrange(3))
        rows.append((f"m{k % 30}", a, b, k % 3 if rng.random() < 0.4 else int(b), f"202{k % 2}-01-01", "all" if k % 4 else None))
    once = spark.createDataFrame(rows, "match_id string, a double, b double, y int, d string, part string")
    often = once.crossJoin(spark.range(5).drop("id"))
    scored, plain = [], leaderboard._predict
    monkeypatch.setattr(leaderboard, "_predict", lambda df, *rest: scored.append(df.count()) or plain(df, *rest))
    cells = [leaderboard.run_cell(
        df, df, df, k=3, features=["a", "b"], fmt="t20", names=("B0_marginal", "B2_logistic"), c_grid=(1.0,), n_boot=60, date="d",
        buckets=F.array_compact(F.array("part"))) for df in (once, often)]
    assert scored[0] == scored[2] == scored[1] == scored[3] < 240
    few, many = [c.cuts.toPandas().sort_values(["model", "facet", "name"]) for c in cells]
    assert (many["n"].to_numpy() == 5 * few["n"].to_numpy()).all() and few["n"].max() < 240 <= few[few.facet == "year"]["n"].sum() / 2
    back = cells[1].test
    assert back.count() == 1200 and {"match_id", "y", "p_0", "c_1"} <= set(back.columns)
    direct = back.select("*", F.explode("__year").alias("name")).groupBy("name").agg(F.avg(
        metrics.nll_multi(F.col("c_1"), F.col("y"), 1e-12)).alias("nll")).toPandas().sort_values("name")
    listed = many[(many.model == "B2_logistic") & (many.facet == "year")]
    assert np.allclose(direct["nll"], listed["nll"], atol=1e-9)
    board = cells[1].board.filter("model = 'B2_logistic' AND split = 'test' AND metric = 'nll'").first()
    assert abs(board["value"] - back.agg(F.avg(metrics.nll_multi(F.col("c_1"), F.col("y"), 1e-12))).first()[0]) < 1e-9
    assert board["lo"] <= board["value"] <= board["hi"]
