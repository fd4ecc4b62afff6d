"""Ordered scans against a sequential restatement, with and without hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foreledger.operators import fold, guards, increments, metrics, resample, scan


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 6, n)), "o": rng.permutation(n),
        "v": rng.integers(0, 7, n), "legal": rng.random(n) < 0.8, "fall": (rng.random(n) < 0.1).astype(int),
        "flag": rng.random(n) < 0.2, "x": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf).cache()


def _sequential(pdf):
    out = {}
    for _, g in pdf.sort_values("o").groupby("g"):
        runs = legal = wk = since = since_l = 0
        fow, flag = (None, None), False
        for r in g.itertuples():
            out[r.o] = (runs, legal, wk, fow[0], fow[1], since, since_l, flag)
            runs, legal, wk = runs + r.v, legal + int(r.legal), wk + r.fall
            since, since_l = (0, 0) if r.fall else (since + r.v, since_l + int(r.legal))
            if r.fall:
                fow = (runs, legal)
            flag = bool(r.flag)
    return out


def test_running_state_matches_sequential_fold(events):
    pdf, df = events
    got = fold.running_state(
        df, ["g"], ["o"], value=F.col("v"), legal=F.col("legal"), falls=F.col("fall"), flag=F.col("flag"),
        chunk=[F.floor(F.col("o") / 37)]).collect()
    want = _sequential(pdf)
    for r in got:
        assert (r.runs, r.legal_balls, r.wickets, r.fow_last_runs, r.fow_last_ball, r.partnership_runs,
                r.partnership_balls, r.last_flag) == want[r.o]


def test_running_sums_and_lasts(events):
    pdf, df = events
    got = scan.running(df, ["g"], ["o"], sums={"s": F.col("v")}, lasts={"l": F.when(F.col("fall") == 1, F.col("v"))},
                       chunk=[F.floor(F.col("o") / 50)]).toPandas().set_index("o")
    for _, g in pdf.sort_values("o").groupby("g"):
        s, last = 0, None
        for r in g.itertuples():
            row = got.loc[r.o]
            assert row.s == s and (pd.isna(row.l) if last is None else row.l == last)
            s += r.v
            last = r.v if r.fall else last


def _kalman(xs, p, a, q):
    m, out = 0.0, []
    for x in xs:
        out.append(m)
        k = p / (p + a)
        m, p = m + k * (x - m), (1 - k) * p + q
    return out


@pytest.mark.parametrize("q", [0.0, 0.05, 2.0])
def test_local_level_matches_recursion(events, q):
    pdf, df = events
    got = increments.local_level(df, "x", ["g"], ["o"], prior_var=1.5, obs_var=2.0, process_var=q,
                                 chunk=[F.floor(F.col("o") / 50)]).toPandas().set_index("o")["theta"]
    for _, g in pdf.sort_values("o").groupby("g"):
        assert np.allclose(got.loc[g["o"]], _kalman(g["x"], 1.5, 2.0, q), atol=1e-10)


def test_future_does_not_reach_the_past(events, spark):
    pdf, df = events
    cut = pdf["o"].median()
    changed = pdf.assign(x=np.where(pdf["o"] > cut, -pdf["x"] * 3, pdf["x"]))
    run = lambda d: increments.causal_mean(d, F.col("x"), ["g"], ["o"], 5.0).toPandas().set_index("o")["theta"]
    a, b = run(df), run(spark.createDataFrame(changed))
    early = [o for o in pdf["o"] if o <= cut]
    assert np.allclose(a.loc[early], b.loc[early])


def test_equal_mass_edges_equal_quantiles(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(400), np.full(300, 0.25), 0.5 + rng.random(300) * 1e-7, [0.0, 1.0]])
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "p": p}))
    edges = scan.equal_mass_edges(df, ["g"], "p", 20).first()["edges"]
    want = np.quantile(p, np.linspace(0, 1, 21)[1:-1])
    assert np.allclose(edges, want, rtol=0, atol=1e-15)


def test_murphy_identity_and_known_scores(spark):
    rng = np.random.default_rng(2)
    p = rng.random(2000)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": (rng.random(2000) < p).astype(int)}))
    m = metrics.murphy(df, "p", "y").first()
    assert abs(m.bs_binned - (m.rel - m.res + m.unc)) < 1e-9
    one = spark.createDataFrame([(0.7, 1)], "p double, y int")
    assert abs(one.select(metrics.brier_binary(F.col("p"), F.col("y"))).first()[0] - 0.09) < 1e-12
    half = spark.createDataFrame([(0.5, 1)], "p double, y int")
    assert abs(half.select(metrics.nll_binary(F.col("p"), F.col("y"))).first()[0] - np.log(2)) < 1e-12


def test_dense_index_is_a_bijection(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = scan.dense_index(df, ["k"], "i").toPandas()
    assert sorted(got["i"]) == list(range(5000))


def test_shuffles_keep_the_multiset(spark):
    df = spark.range(900).select(F.col("id").alias("k"), (F.col("id") % 3).alias("y"), (F.col("id") % 40).alias("e"))
    a = guards.shuffle_labels(df, "y", ["k"]).toPandas()
    b = guards.shuffle_column(df, "e", ["k"]).toPandas()
    assert a["y"].value_counts().to_dict() == {0: 300, 1: 300, 2: 300}
    assert sorted(b["e"]) == sorted(df.toPandas()["e"]) and (b.sort_values("k")["e"].to_numpy() != np.arange(900) % 40).any()


def test_both_bootstrap_paths_draw_alike(spark, monkeypatch):
    losses = spark.createDataFrame([(i, 1 + i % 3, float(i)) for i in range(50)], "g long, n long, s double")
    a = resample.replicate_sums(losses, ["g"], ["s"], n_boot=40).orderBy("replicate").toPandas()
    monkeypatch.setattr(resample, "BROADCAST_GROUPS", 1)
    b = resample.replicate_sums(losses, ["g"], ["s"], n_boot=40).orderBy("replicate").toPandas()
    assert np.allclose(a[["n", "s"]], b[["n", "s"]])


def test_many_groups_are_drawn_without_a_shuffle_of_draws(spark, monkeypatch):
    losses = spark.range(300, numPartitions=2).selectExpr("id AS g", "1 + id % 3 AS n", "if(id = 7, double('nan'), double(id)) AS s")
    want = resample.draws(spark, 300, 20).join(
        scan.dense_index(losses, ["g"], "idx"), "idx").groupBy("replicate").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    want = want.orderBy("replicate").toPandas()
    monkeypatch.setattr(resample, "BROADCAST_GROUPS", 40)
    monkeypatch.setattr(resample, "SLAB", 64)
    got = resample.replicate_sums(losses, ["g"], ["s"], n_boot=20)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.orderBy("replicate").toPandas()
    assert 0 < want["s"].isna().sum() < 20
    assert np.allclose(got[["n", "s"]], want[["n", "s"]], equal_nan=True)


def test_counts_of_draws_may_exceed_a_byte(monkeypatch):
    monkeypatch.setattr(resample, "draw_indices", lambda seed, replicate, n: iter([np.zeros(700, np.int64), np.arange(n)]))
    assert resample.draw_counts(1, 0, 5, 0, 5).tolist() == [701, 1, 1, 1, 1]


def test_group_losses_fixture(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 10.0), ("a", 3.0), ("c", 5.0)], "m string, l double")
    got = {r.m: (r.l, r.n) for r in metrics.group_losses(df, ["m"], {"l": F.col("l")}).collect()}
    assert got == {"a": (6.0, 3), "b": (10.0, 1), "c": (5.0, 1)}


def test_the_shuffle_of_a_scan_moves_no_derived_value(spark):
    from foreledger.operators.scan import running

    df = spark.range(100).selectExpr("id % 5 AS g", "id AS t", "id AS v")
    r = running(df, ["g"], ["t"], sums={"n": F.col("v") * 2}, chunk=[F.floor(F.col("t") / 10)])
    lines = r._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [i for i, line in enumerate(lines) if "RepartitionByExpression" in line]
    assert dealt and not any("__s_n" in lines[i + 1] for i in dealt)
    assert {(x["t"], x["n"]) for x in r.collect()} == {(t, 2 * sum(range(t % 5, t, 5))) for t in range(100)}


def test_ledger_moves_rows_once_and_cuts_large_groups_only(spark, monkeypatch):
    df = spark.range(600, numPartitions=3).selectExpr(
        "CASE WHEN id < 400 THEN 1 WHEN id < 450 THEN null ELSE id % 40 END AS g", "id AS t", "id * 7 % 5 AS who", "double(id) AS v")
    ledger = lambda chunk: fold.actor_ledger(
        df, ["g"], ["t"], "who", counters={"n": F.lit(1), "s": F.col("v")}, chunk=chunk)
    chunk = [F.floor(F.col("t") / 10)]
    plan = ledger(chunk)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    want = sorted(map(str, ledger([]).collect()))
    assert sorted(map(str, ledger(chunk).collect())) == want
    monkeypatch.setattr(scan, "WHOLE_ROWS", 100)
    cut = ledger(chunk)
    assert "Join" in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, cut.collect())) == want
