"""Document checks, the innings fold against a sequential restatement, sinks, streaming, labels."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foreledger.operators import events, features, fold, labels, validate
from foreledger.plans import corpus
from foreledger.sources import schemas, tables


def make_doc(overs, **over):
    names = {n: f"id{n}" for n in [f"P{i}" for i in range(12)] + ["B0", "B1", "B2"]}
    info = {"balls_per_over": 6, "dates": ["2024-03-01"], "gender": "male", "match_type": "T20", "outcome": {"winner": "A"},
            "overs": 20, "registry": {"people": names}, "teams": ["A", "B"], "toss": {"decision": "bat", "winner": "A"}, "venue": "V"}
    info.update(over.pop("info", {}))
    doc = {"meta": {"data_version": "1.2.0"}, "info": info,
           "innings": [{"team": "A", "overs": [{"over": i, "deliveries": o} for i, o in enumerate(overs)]}]}
    doc.update(over)
    return doc


def ball(bat="P0", non="P1", bowl="B0", runs=0, wides=0, noballs=0, wickets=()):
    d = {"batter": bat, "non_striker": non, "bowler": bowl,
         "runs": {"batter": runs, "extras": wides + noballs, "total": runs + wides + noballs}}
    x = {k: v for k, v in (("wides", wides), ("noballs", noballs)) if v}
    if x:
        d["extras"] = x
    if wickets:
        d["wickets"] = [{"player_out": p, "kind": k} for p, k in wickets]
    return d


def one_over(**kw):
    return [[ball(**kw)] * 6]


CASES = {
    "ok": (make_doc(one_over()), None),
    "array": ([1], "E_SCHEMA"), "text": ("{", "E_OTHER"),
    "version": (make_doc(one_over(), meta={"data_version": "1.1.0"}), "E_VERSION"),
    "scope": (make_doc(one_over(), info={"match_type": "Test", "odd": 1}), "E_FORMAT_OOS"),
    "info_key": (make_doc(one_over(), info={"odd": 1}), "E_SCHEMA"),
    "bool_int": (make_doc(one_over(), info={"overs": True}), "E_SCHEMA"),
    "no_dates": (make_doc(one_over(), info={"dates": []}), "E_SCHEMA"),
    "bad_date": (make_doc(one_over(), info={"dates": ["soon"]}), "E_OTHER"),
    "three_teams": (make_doc(one_over(), info={"teams": ["A", "B", "C"]}), "E_SCHEMA"),
    "stranger": (make_doc(one_over(bowl="X")), "E_REGISTRY_MISS"),
    "sum": (make_doc([[ball() | {"runs": {"batter": 1, "extras": 0, "total": 2}}]]), "E_BALL_ACCOUNTING"),
    "kind": (make_doc([[ball(wickets=[("P0", "vanished")])]]), "E_UNKNOWN_WICKET_KIND"),
    "delivery_key": (make_doc([[ball() | {"odd": 1}]]), "E_SCHEMA"),
    "short_over": (make_doc([[ball()] * 5, [ball()] * 6]), "E_BALL_ACCOUNTING"),
    "crowded": (make_doc([[ball(), ball(bat="P5")]]), "E_BALL_ACCOUNTING"),
    "absent": (make_doc([[ball(wickets=[("P7", "bowled")])]]), "E_BALL_ACCOUNTING"),
    "twin": (make_doc([[ball(bat="P0", non="P0")]]), "E_SCHEMA"),
    "dead": (make_doc([[ball()] * 6, [ball()] * 6], info={"overs": 1}), "E_DEAD_STATE"),
    "long_runs": (make_doc([[ball() | {"runs": {"batter": 3_000_000_000, "extras": 0, "total": 1}}]]), "E_BALL_ACCOUNTING"),
    "long_sum": (make_doc([[ball() | {"runs": {"batter": 3_000_000_000, "extras": 0, "total": 3_000_000_000}}]]), "E_OTHER"),
    "long_target": (make_doc([], innings=[{"team": "A", "overs": [], "target": {"runs": 10**10}}]), "E_OTHER"),
    "penalty_list": (make_doc([], innings=[{"team": "A", "overs": [], "penalty_runs": [5]}]), "E_OTHER"),
    "penalty_word": (make_doc([], innings=[{"team": "A", "overs": [], "penalty_runs": {"pre": "five"}}]), "E_OTHER"),
    "event_text": (make_doc(one_over(), info={"event": "Cup"}), "E_OTHER"),
    "event_empty": (make_doc(one_over(), info={"event": ""}), None),
    "absent_object": (make_doc([], innings=[{"team": "A", "overs": [], "absent_hurt": {"X": 1}}]), "E_REGISTRY_MISS"),
    "absent_known": (make_doc([], innings=[{"team": "A", "overs": [], "absent_hurt": ["P1"]}]), None),
    "absent_number": (make_doc([], innings=[{"team": "A", "overs": [], "absent_hurt": 3}]), "E_OTHER"),
    "balls_true": (make_doc([], innings=[{"team": "A", "overs": [], "miscounted_overs": {"3": {"balls": True}}}]), None),
    "short_date": (make_doc(one_over(), info={"dates": ["20240301"]}), None),
}


def frame(spark, docs):
    return spark.createDataFrame([(k, d if isinstance(d, str) else json.dumps(d)) for k, d in docs.items()],
                                 "match_id string, raw string")


def test_first_failure_codes(spark):
    b = corpus.build(frame(spark, {k: d for k, (d, _) in CASES.items()}))
    got = {r.match_id: r.reason for r in b.quarantine.collect()}
    assert got == {k: r for k, (_, r) in CASES.items() if r}
    assert {r.match_id for r in b.matches.collect()} == {k for k, (_, r) in CASES.items() if not r}


def test_loosely_typed_values_are_read(spark):
    inn = {"team": "A", "super_over": "false", "penalty_runs": {"pre": "5", "post": True},
           "overs": [{"over": 0, "deliveries": [ball()] * 6}]}
    doc = make_doc([], innings=[inn], info={"toss": {"uncontested": "no"}, "event": {"name": "Cup"}})
    checked = events.checked_documents(frame(spark, {"m": doc}))
    assert checked.first()["error"] is None
    head = events.headers(checked).first()
    assert (head.has_super_over, head.toss_uncontested, head.competition) == (True, True, "Cup")
    assert {r.penalty_pre for r in events.flatten(checked).collect()} == {5}


def random_innings(rng):
    """A legal-looking innings with dismissals, retirements and returns."""
    pair, bench, retired, overs, wk = ["P0", "P1"], [f"P{i}" for i in range(2, 12)], [], [], 0
    for _ in range(rng.randint(1, 8)):
        legal, over = 0, []
        while legal < 6:
            if len(pair) < 2:
                if retired and rng.random() < 0.5:
                    pair.append(retired.pop(0))
                elif bench:
                    pair.append(bench.pop(0))
                else:
                    return overs + ([over] if over else [])
            rng.shuffle(pair)
            w, n = int(rng.random() < 0.08), int(rng.random() < 0.05)
            n = 0 if w else n
            outs = []
            if wk < 8 and rng.random() < 0.2:
                who = rng.choice(pair)
                kind = rng.choice(["bowled", "run out", "retired hurt"])
                outs = [(who, kind)]
            over.append(ball(pair[0], pair[1], f"B{rng.randint(0, 2)}", rng.randint(0, 6), w, n, outs))
            legal += int(not w and not n)
            for who, kind in outs:
                pair.remove(who)
                (retired.append(who) if kind == "retired hurt" else None)
                wk += kind != "retired hurt"
        overs.append(over)
    return overs


def restated(overs):
    """Pre-ball (striker, non-striker, bowler) triples by walking the innings ball by ball."""
    slots, bat_book, bowl_book, held, balls = [None, None], {}, {}, None, 0
    for over in overs:
        for d in over:
            b, n, w = d["batter"], d["non_striker"], d["bowler"]
            now = {s[0] for s in slots if s}
            for i, p in enumerate((b, n)):
                if p not in now and p in bat_book and slots[i] is None:
                    slots[i] = bat_book[p]
            held = held or (w, 0, 0)
            if held[0] != w and w in bowl_book:
                held = bowl_book[w]
            yield slots[0], slots[1], held
            x = d.get("extras", {})
            legal = int(not x)
            book = {s[0]: s for s in slots if s}
            one, two = (book.get(p, (p, 0, 0)) for p in (b, n))
            one = (b, one[1] + d["runs"]["batter"], one[2] + legal)
            conceded = d["runs"]["batter"] + sum(x.values())
            old = held if held[0] == w else (w, 0, 0)
            held = bowl_book[w] = (w, old[1] + legal, old[2] + conceded)
            balls += legal
            out = {v["player_out"] for v in d.get("wickets", [])}
            slots = [None if s[0] in out else s for s in (one, two)]
            swaps = (d["runs"]["batter"] + max(x.get("wides", 0) - 1, 0)) % 2 + int(legal and balls % 6 == 0)
            if swaps == 1:
                slots.reverse()
            bat_book.update({s[0]: s for s in slots if s})


def test_fold_matches_sequential_walk(spark):
    rng = random.Random(11)
    innings = {f"m{i:03d}": random_innings(rng) for i in range(60)}
    docs = frame(spark, {k: make_doc(o) for k, o in innings.items()})
    sound = events.checked_documents(docs).filter("error is null")
    rows = fold.innings_fold(events.flatten(sound)).orderBy("match_id", "over_pos", "ball_in_over").collect()
    got, returns = {}, 0
    for r in rows:
        assert r.event_error is None
        side = lambda i, x, y: (i[2:], x, y) if i else None
        got.setdefault(r.match_id, []).append((
            side(r.striker_id, r.striker_runs, r.striker_balls),
            side(r.non_striker_id, r.non_striker_runs, r.non_striker_balls),
            (r.bowler_id[2:], r.bowler_legal_balls, r.bowler_runs_conceded)))
    for k, o in innings.items():
        want = list(restated(o))
        assert got[k] == want
        returns += sum("retired" in w["kind"] for ov in o for d in ov for w in d.get("wickets", []))
    assert returns > 20


def test_tables_round_trip_in_declared_schema(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in ("ok", "sum"):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(CASES[k][0]))
    docs = tables.read_documents(spark, str(tmp_path / "in"))
    assert {r.match_id for r in docs.collect()} == {"ok", "sum"}
    b = corpus.build(docs)
    corpus.write(b, str(tmp_path / "out"))
    facts = tables.read_table(spark, str(tmp_path / "out" / "deliveries"))
    assert facts.count() == 6 and set(facts.columns) == set(schemas.FACT_SCHEMA.names)
    q = tables.read_quarantine(spark, str(tmp_path / "out" / "quarantine")).collect()
    assert [(r.match_id, r.reason) for r in q] == [("sum", "E_BALL_ACCOUNTING")]
    assert len(schemas.FACT_SCHEMA) == 50 and len(schemas.MATCH_SCHEMA) == 24


def test_markers_and_label_shapes(spark):
    df = spark.createDataFrame([("17.2",), ("0.11",), ("5",), ("4.7",)], "m string")
    got = [r[0] for r in df.select(events.overs_to_balls(F.col("m"), F.lit(6))).collect()]
    assert got == [104, None, 30, None]
    shapes = spark.sql("""SELECT * FROM VALUES (true), (false) a(nr), VALUES (null), ('tie'), ('no result') b(res),
      VALUES (null), ('A'), ('B') c(w), VALUES (null), ('A'), ('B') d(e), VALUES (null), ('A'), ('B') f(bo)""")
    r = shapes.withColumn("r", labels.resolve(F.col("nr"), F.col("res"), F.col("w"), F.col("e"), F.col("bo"), F.lit("A")))
    for x in r.collect():
        assert (x.r.disposition is None) != (x.r.error is None)
        assert (x.r.y is not None) == (x.r.disposition == "LABELED")


def test_feature_contract(spark):
    assert not features.denylist_violations(features.FEATURE_COLUMNS) and len(features.FEATURE_COLUMNS) == 27
    with pytest.raises(ValueError):
        features.build_features(spark.range(1))
    with pytest.raises(features.TestSplitRefused):
        features.slice_rows(spark.range(1), "t20", "test")
    assert len(validate.WICKET_KINDS) == 13


def test_matches_that_begin_and_end_anywhere_equal_their_sql(spark, tmp_path):
    """Runs of event ids with gaps: planted balls, first innings or both may be missing."""
    import duckdb
    from harness import compare

    from foreledger.catalog import documents

    runs = [(m * 240 + start, n) for m, (start, n) in enumerate([
        (0, 240), (130, 30), (60, 180), (200, 40), (10, 20), (0, 3), (125, 115)] * 7)]
    con = duckdb.connect()
    con.execute("CREATE TABLE r (lo BIGINT, n BIGINT)")
    con.executemany("INSERT INTO r VALUES (?, ?)", runs)
    con.execute(f"""COPY (SELECT e.* REPLACE (r.lo + k AS event_id) FROM (SELECT lo, unnest(range(n)) AS k FROM r) r
      JOIN '/root/testdata/sf0.1/events.parquet' e ON e.event_id = r.lo + k) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("v1_structure_errors", "p1_flatten", "k16_label_tree"):
        message, same = compare(spark, con, str(tmp_path), name, documents.QUERIES[name], documents.SQL[name])
        assert same, (name, message)


def test_the_fold_takes_more_tasks_for_more_deliveries(spark, monkeypatch):
    rows = [(f"m{k}", json.dumps(make_doc(one_over(), info={"outcome": {"winner": "A"}}))) for k in range(30)]
    docs = spark.createDataFrame(rows, "match_id string, raw string")
    asked = []
    plain = fold.innings_fold
    monkeypatch.setattr(fold, "TASK_BALLS", 10)  # 180 deliveries
    monkeypatch.setattr(fold, "innings_fold", lambda e, tasks=None: asked.append(tasks) or plain(e, tasks))
    assert corpus.build(docs).facts.count() == 180
    assert asked == [18] and fold.fold_tasks(40, 4) is None and fold.fold_tasks(50, 4) == 5


def test_more_departures_than_a_side_has_batters(spark, tmp_path):
    """Innings of alike events, most of which lose a wicket: whoever walks in is known, and SQL agrees."""
    import duckdb
    from harness import compare

    from foreledger.catalog import documents

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (event_id * 60 + k AS event_id) FROM '/root/testdata/sf0.1/events.parquet', range(60) r(k)
      WHERE event_id BETWEEN 760 AND 800) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("v1_structure_errors", "p7_headers"):
        message, same = compare(spark, con, str(tmp_path), name, documents.QUERIES[name], documents.SQL[name])
        assert same, (name, message)


def test_names_of_ten_digits_and_a_lone_planted_ball(spark, tmp_path):
    """Matches whose shown names are one, and an innings of the planted ball alone: the quarantine equals SQL."""
    import duckdb
    from harness import compare

    from foreledger.catalog import documents

    con = duckdb.connect()
    events = "'/root/testdata/sf0.1/events.parquet'"
    far = f"SELECT * REPLACE (event_id + 300000000000 AS event_id) FROM {events} WHERE event_id < 4800"
    lone = f"SELECT * REPLACE (240 * 29 + 90 AS event_id, 'click' AS event_type, 0.01 AS value) FROM {events} WHERE event_id = 0"
    con.execute(f"COPY ({far} UNION ALL {lone}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    message, same = compare(spark, con, str(tmp_path), "v11", documents.QUERIES["v11_quarantine"], documents.SQL["v11_quarantine"])
    assert same, message


def test_ids_beyond_the_digits_of_a_double(spark, tmp_path):
    """Matches of ids up to 5.9e16: every delivery stays in its own match."""
    import duckdb
    from harness import compare

    from foreledger.catalog import documents

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (event_id + k * 1000000000000037 AS event_id) FROM '/root/testdata/sf0.1/events.parquet', range(50, 60) r(k)
      WHERE event_id < 1000) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    message, same = compare(spark, con, str(tmp_path), "p1_flatten", documents.QUERIES["p1_flatten"], documents.SQL["p1_flatten"])
    assert same, message
