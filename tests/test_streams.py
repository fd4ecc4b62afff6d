"""Streams: expiry of silent innings, documents routed once over restarts and failures; scans of affine maps."""

import random

import pytest
from pyspark.sql import functions as F

from foreledger.catalog.streams import _fed, _keyed_state
from foreledger.operators import increments, splits
from foreledger.plans import corpus
from foreledger.sources.stored import scratch_path
from foreledger.streaming import documents as SD
from foreledger.streaming.fold import drain_to
from foreledger.streaming.innings import stream_innings

BALL = ("match_id string, innings_idx int, over_pos int, ball_in_over int, penalty_pre int, batter_id string, event_non_striker_id string, "
        "event_bowler_id string, outs array<struct<player_out: string, kind: string>>, target int, dls_applied boolean, max_balls int, "
        "balls_per_over int, outcome_runs_batter int, outcome_runs_total int, outcome_wides int, outcome_noballs int, outcome_byes int, "
        "outcome_legbyes int")


def ball(match, over, k, bat=0, outs=(), pair=("a", "b"), bowler="x"):
    return (match, 1, over, k, 0, *pair, bowler, list(outs), None, False, 120, 6, bat, bat, 0, 0, 0, 0)


def run_innings(spark, batches, idle_ms):
    base = scratch_path(spark, "innings")
    frames = [spark.createDataFrame(b, BALL) for b in batches]
    with _keyed_state(spark):
        drain_to(stream_innings(_fed(spark, frames, f"{base}/in", "match_id"), idle_ms), f"{base}/out", f"{base}/ckpt")
    return {(r["match_id"], r["over_pos"], r["ball_in_over"], r["late"]): r for r in spark.read.parquet(f"{base}/out").collect()}


def test_state_goes_on_over_micro_batches(spark):
    out = [("b", "caught")]
    got = run_innings(spark, [
        [ball("m", 0, 1, 1), ball("m", 0, 2, 0, out, ("b", "a"))], [ball("m", 0, 3, 4, (), ("c", "a")), ball("m", 0, 2)],
        [ball("m", 0, 4, 0, (), ("q", "r")), ball("m", 0, 5)]], 10**9)
    assert got[("m", 0, 2, False)]["striker_id"] == "b" and got[("m", 0, 2, False)]["runs"] == 1
    third = got[("m", 0, 3, False)]
    assert (third["wickets"], third["striker_id"], third["non_striker_id"], third["non_striker_runs"], third["bowler_wickets"]) == (1, None, "a", 1, 1)
    assert got[("m", 0, 2, True)]["runs"] is None
    assert got[("m", 0, 4, False)]["reason"] == "E_BALL_ACCOUNTING" and ("m", 0, 5, False) not in got


def test_silent_innings_are_forgotten(spark):
    batches = [[ball("m", 0, 1, 4)], [ball("n", 0, 1)], [ball("m", 0, 2)]]
    assert run_innings(spark, batches, 1)[("m", 0, 2, False)]["runs"] == 0
    assert run_innings(spark, batches, 10**9)[("m", 0, 2, False)]["runs"] == 4


def test_documents_are_routed_once(spark, monkeypatch):
    """Sent twice, stopped, restarted, and failed between the tables and the commit."""
    from foreledger.catalog.documents import documents

    base = scratch_path(spark, "docs")
    docs = corpus.stored(documents(spark, "/root/testdata/sf0.001"))
    bounds = corpus.stored(splits.temporal_bounds(corpus.scope_dates(docs), "start_date"))
    want = {r["match_id"]: r["reason"] for r in corpus.build(docs).quarantine.collect()}
    go = lambda: SD.route_documents(
        SD.read_document_stream(spark, f"{base}/in"), bounds, f"{base}/out", f"{base}/ckpt").awaitTermination()
    send = lambda d: d.select("raw", "match_id").write.mode("append").partitionBy("match_id").text(f"{base}/in")
    with _keyed_state(spark):
        send(docs.limit(2))
        build, calls = corpus.build, []

        def failing(*a, **k):
            calls.append(1)
            if len(calls) == 1:
                built = build(*a, **k)
                built.facts.write.mode("overwrite").parquet(f"{base}/out/facts/epoch=0")
                raise RuntimeError("lost")
            return build(*a, **k)

        monkeypatch.setattr(SD.corpus, "build", failing)
        with pytest.raises(Exception, match="lost"):
            go()
        go()
        send(docs)
        go()
    got = [tuple(r) for r in spark.read.parquet(f"{base}/out/quarantine").select("match_id", "reason").collect()]
    assert sorted(got) == sorted(want.items())
    facts = spark.read.parquet(f"{base}/out/facts")
    assert facts.count() == build(docs).facts.count() == facts.select("match_id", "innings_idx", "over_number", "ball_in_over").distinct().count()


def test_affine_prefix_over_levels(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for g, n in ((None, 3), ("a", 40_000), ("b", 1)):
        m = 0.0
        for k in range(n):
            scale, shift = rng.uniform(0, 1), rng.uniform(-1, 1)
            rows.append((g, k, scale, shift))
            want[g, k] = m
            m = scale * m + shift
    maps = spark.createDataFrame(rows, "g string, k long, scale double, shift double")
    got = {(r["g"], r["k"]): r["start"] for r in increments.affine_prefix(maps, ["g"], "k", fan=16).collect()}
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 1e-12


def test_local_level_of_a_long_group(spark):
    rows = [(k, float(k * 7919 % 101)) for k in range(20_000)]
    frame = spark.createDataFrame(rows, "k long, x double").withColumn("g", F.lit("one"))
    got = increments.local_level(frame, "x", ["g"], ["k"], prior_var=1.0, obs_var=1.0, process_var=50.0, chunk=[F.floor(F.col("k") / 1000)])
    mean, p = 0.0, 1.0
    want = []
    for _, x in rows:
        want.append(mean)
        gain = p / (p + 1.0)
        mean, p = mean + gain * (x - mean), p * (1 - gain) + 50.0
    assert max(abs(r["theta"] - want[r["k"]]) for r in got.collect()) < 1e-9
