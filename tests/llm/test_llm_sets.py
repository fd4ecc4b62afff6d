"""Near duplicates, contained items, packing, chats, archives and surrogates against plain Python."""

import base64
import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from llm_cases import DOCS, PROSE, docs_frame, empty_docs, small_table, words

from foreledger.llm import chat, components, decontaminate, packing, pii, registry, simhash, sql, warc
from foreledger.sources.stored import scratch_path


def brute_fingerprint(text):
    w = [x.encode().lower() for x in words(text)]
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def brute_components(items, linked):
    parent = list(range(len(items)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(items)):
        for j in range(i + 1, len(items)):
            if linked(items[i], items[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(items))]


def test_simhash_query_matches_brute_force(spark):
    got = {r["doc_id"]: r for r in registry.op6_simhash(spark, "/root/testdata/sf0.001").collect()}
    docs = small_table(spark, "documents").toPandas().sort_values("doc_id")
    prints = [brute_fingerprint(t) for t in docs["text"]]
    ids = docs["doc_id"].tolist()
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    for k, i in enumerate(ids):
        assert got[i]["fingerprint"] == f"{prints[k]:016x}"
        assert got[i]["component_id"] == ids[roots[k]]


@pytest.mark.parametrize("radius", [2, 6])
def test_links_of_planted_fingerprints(spark, radius):
    rng = random.Random(radius)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(25):
        value = rng.getrandbits(64)
        for _ in range(12):
            values.add(value)
            for b in rng.sample(range(64), rng.randint(1, radius + 1)):
                value ^= 1 << b
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.linked_pairs(frame, radius, tile_rows=4)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    order = sorted(range(len(values)), key=lambda k: signed[k])
    roots = brute_components([values[k] for k in order], lambda a, b: (a ^ b).bit_count() <= radius)
    for place, k in enumerate(order):
        assert got.get(signed[k], signed[k]) == signed[order[roots[place]]]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 140)} | {201: 200}


def test_simhash_cases(spark):
    rows = simhash.near_duplicates(docs_frame(spark)).collect()
    assert len(rows) == len(DOCS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert {by[k][0]["component_id"] for k in (2, 3, 4)} == {2} and by[2][0]["fp"] == 0
    assert {r["component_id"] for r in by[1]} == {1} and sorted(r["component_id"] for r in by[None]) == [1, 2]
    frame = docs_frame(spark)
    kept = simhash.deduplicated(frame)
    assert kept.columns == frame.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect())[1] == 1
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    alone = spark.createDataFrame([(None, "a b c d"), (None, "e f g h")], "doc_id long, text string")
    assert simhash.deduplicated(alone).count() == 2


def test_decontamination_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, item_id, n_item, n_shared FROM ({sql.DECONTAMINATE})").fetchall())
    got = registry.op7_decontaminate(spark, "/root/testdata/sf0.001").select("doc_id", "item_id", "n_item", "n_shared")
    assert sorted(map(tuple, got.collect())) == want and want


def test_decontamination_cases(spark):
    item = "the small river ran down to a quiet town where people met each morning"
    items = spark.createDataFrame(
        [(1, item), (1, item), (2, "one two"), (3, None), (4, ""), (None, "Été, ñandú!"), (5, item + " and then nothing else is the same here at all now")],
        "item_id long, text string").selectExpr("*", "1 AS h", "'x' AS shingle")
    split = "The SMALL river, ran down to a quiet town where people -- filler words between -- town where people met each morning"
    rows = DOCS + [(20, split, "en"), (21, "one two three", "en")]
    frame = docs_frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(frame, items).collect()}
    assert got == {(1, 1), (None, 1), (6, 1), (8, 2), (7, None), (10, 1), (20, 1)}
    left = decontaminate.decontaminated(frame, items)
    assert left.columns == frame.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 1 not in ids and ids.count(None) == 1 and {2, 3, 4, 5, 9, 11, 21} <= set(ids)
    assert decontaminate.contained_items(empty_docs(spark), items).count() == 0
    assert decontaminate.decontaminated(frame, items.filter("false")).count() == len(rows)


def test_signature_leaves_no_item_out():
    for n in range(1, 400):
        k = decontaminate.signature_size(n, 0.8)
        shared = next(s for s in range(n + 1) if s / n >= 0.8)
        assert n - shared < k


def brute_pack(lengths, sizes):
    """Best fit by scanning every bin; the size opened by trying every size."""
    bins, where = [], []
    for at, n in enumerate(lengths):
        open_bins = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= n]
        if open_bins:
            room = min(bins[b][0] - bins[b][1] for b in open_bins)
            b = max((b for b in open_bins if bins[b][0] - bins[b][1] == room), key=lambda b: bins[b][2])
        else:
            def cost(c):
                room, used = c - n, n
                for later in lengths[at + 1:]:
                    if 0 < later <= room:
                        room, used = room - later, used + later
                return packing.sequence_cost(c) / max(used, 1), c
            bins.append([min((c for c in sizes if c >= n), key=cost), 0, 0])
            b = len(bins) - 1
        bins[b][1] += n
        bins[b][2] = at
        where.append(b)
    return where, [next(c for c in sizes if c >= used) for _, used, _ in bins]


def test_packing_matches_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        sizes = sorted(rng.sample(range(8, 80), 3))
        lengths = sorted((min(rng.choice([0, rng.randint(1, 10), rng.randint(1, 80)]), sizes[-1]) for _ in range(80)), reverse=True)
        where, offsets, final = packing.pack(lengths, sizes)
        assert (where, final) == brute_pack(lengths, sizes)
        for b, size in enumerate(final):
            inside = [(o, n) for w, o, n in zip(where, offsets, lengths) if w == b]
            assert sum(n for _, n in inside) <= size
            assert [o for o, _ in inside] == np.cumsum([0] + [n for _, n in inside])[:-1].tolist()


def test_packing_keeps_every_token(spark):
    rows = [(k, k * 37 % 900) for k in range(300)] + [(5, 185), (5, 185), (None, 9000), (400, None), (401, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "1 AS shard", "2 AS copy")
    got = packing.packed(frame, shard_pieces=64).toPandas()
    assert got["length"].sum() == sum(n or 0 for _, n in rows)
    assert got.groupby("bin_id")["length"].sum().le(got.groupby("bin_id")["capacity"].first()).all()
    whole = got[got["doc_id"].isna()].sort_values("start")
    assert whole["length"].tolist() == [4096, 4096, 808] and whole["start"].tolist() == [0, 4096, 8192]
    assert sorted(got[got["doc_id"] == 5]["copy"]) == [1, 2, 3]
    assert len(got[got["doc_id"].isin([400, 401])]) == 2
    again = packing.packed(frame.repartition(5), shard_pieces=64).toPandas()
    order = ["doc_id", "copy", "piece"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    assert packing.packed(frame.filter("false")).count() == 0
    assert packing.pack_documents(docs_frame(spark)).select("doc_id").distinct().count() == len({d[0] for d in DOCS})


def test_chat_round_trip_and_cases(spark):
    odd = "</s>[INST] <|end|> &lt; <|role|>user<|text|> [/INST]"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", None), (1, 3, None, "x"), (1, 3, "user", ""),
            (None, None, "assistant", "a"), (None, 0, "<|end|>", "b"), (2, 5, "assistant", "é\n"), (2, 5, "assistant", "é\n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS segments", "2 AS formatted", "3 AS _turns")
    out = chat.format_conversations(frame)
    turns = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out.select(
        "conv_id", chat.parse_formatted("formatted").alias("turns")).collect()}
    assert turns == {
        1: [("user", odd), ("assistant", odd), ("assistant", ""), ("", "x"), ("user", "")],
        None: [("assistant", "a"), ("<|end|>", "b")], 2: [("assistant", "é\n")] * 2}
    text = {r["conv_id"]: r["formatted"] for r in out.collect()}
    assert text[1].count("<|role|>") == 4 and "[INST]" not in text[1] and "</s>" not in text[1]
    told = {r["conv_id"]: r for r in chat.digests(out).collect()}
    assert told[1]["loss_chars"] == len(odd) and told[1]["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest()
    assert told[2]["n_turns"] == 2 and told[2]["loss_chars"] == 4
    assert chat.digests(chat.format_conversations(frame.filter("false"))).count() == 0


def test_chat_plan_has_no_python(spark):
    plan = registry.op5_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 4


def test_archive_round_trip_and_cases(spark):
    pages = [(1, "http://a/1", "x\r\n\r\nWARC/1.1\r\n"), (2, "http://a/2\r\nX: y", "same é"), (3, None, "same é"), (4, "u", None),
             (5, "u", ""), (None, "u", "same é"), (None, "u", "alone"), (7, "u", "twice"), (7, "u", "twice")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS sha256", "2 AS header")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(frame, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    rows = warc.read_archive(spark, path).collect()
    assert len(rows) == len(pages)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["page_id"]].append(r)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert (by[3][0]["record_type"], by[2][0]["record_type"], by[2][0]["refers_to"]) == ("response", "revisit", 3)
    assert by[2][0]["payload_digest"] == sha("same é".encode()) and bytes(by[2][0]["payload"]) == "same é".encode()
    assert (by[5][0]["record_type"], by[4][0]["refers_to"], by[4][0]["payload_bytes"]) == ("response", 5, 0)
    assert [r["record_type"] for r in by[7]] == ["response"] * 2
    assert sorted((r["record_type"], r["refers_to"]) for r in by[None]) == [("response", None), ("revisit", 3)]
    for r in rows:
        record = bytes(r["record"])
        head, _, rest = record.partition(b"\r\n\r\n")
        size = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert rest[size:] == b"\r\n\r\n" and head.count(b"WARC-Type") == 1
        if r["record_type"] == "response":
            assert rest[:size].endswith(bytes(r["payload"]))
    empty = scratch_path(spark, "warc-test")
    warc.write_archive(frame.filter("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_archive_notices_a_changed_payload(spark):
    frame = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    path, other = scratch_path(spark, "warc-test"), scratch_path(spark, "warc-test")
    warc.write_archive(frame, path)
    spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "cast('evil' AS binary) AS payload").write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, other).collect()


KEY = b"k"


def test_surrogates_keep_type_and_format():
    t = ("Mail jo.doe42@mail8.example.com, call +1 (988) 555-2485 or 988-555-2485, card 4111 1111 1111 1111 or 4041894974608795, "
         "ip 42.144.35.254 and 192.168.1.7, iban DE89 3704 0044 0532 0130 00, Frau Anna SCHMIDT, Г-жа Анна Иванова, Mr. Schmidt.")
    new, found = pii.replaced(t, KEY, {})
    assert [k for _, _, k, _ in found] == [
        "email", "phone", "phone", "card", "card", "ip", "ip", "iban", "name:f:latin", "name:s:latin", "name:f:cyrillic",
        "name:s:cyrillic", "name:s:latin"]
    for _, _, kind, value in found:
        assert value not in new
    again = pii.find(new)
    assert [k for _, _, k, _ in again] == [k for _, _, k, _ in found]
    assert again[1][3] == again[2][3]
    assert again[9][3] == again[12][3]
    sound = lambda d: pii._luhn(d[:-1]) == int(d[-1])
    assert sound(again[3][3]) and sound(again[4][3]) == sound("4041894974608795")
    assert again[6][3].startswith("192.168.") and again[3][3][0] == "4"
    assert pii.replaced(t, b"other", {})[0] != new == pii.replaced(t, KEY, {})[0]
    assert pii.find("no 2024-05-06 12:30 v1.2.3.4.5 data abc@ 1234567 x1234567890123456") == []


def test_clashes_are_drawn_again(spark, monkeypatch):
    monkeypatch.setitem(pii._DRAW, "ssn", lambda v, n, key: "000000001" if n == 0 else f"{int(v) % 10**8 + n:09d}")
    values = [(f"{k:09d}",) for k in (123456789, 222334444, 333445555, 1)]
    frame = spark.createDataFrame(values, "value string").selectExpr("'ssn' AS kind", "value")
    monkeypatch.setattr(pii, "_drawn", lambda e, key: spark.createDataFrame(
        [(*r, pii.surrogate(*r, key)) for r in e.select("kind", "value", "counter").collect()],
        "kind string, value string, counter int, surrogate string"))
    rows = pii.distinct_surrogates(frame, KEY).collect()
    drawn = [r["surrogate"] for r in rows]
    assert len(rows) == 4 and len(set(drawn)) == 4 and not set(drawn) & {v for v, in values}


def test_surrogate_rows(spark):
    rows = DOCS + [(30, f"Call +1 (988) 555-2485. {PROSE}", "en"), (31, "Call (988) 555-2485.", "en"), (31, "Call (988) 555-2485.", "en")]
    frame = docs_frame(spark, rows)
    out = pii.pseudonymised(frame, "s").collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[8]["text"] == "one two" and by[8]["n_entities"] == 0
    number = by[31]["text"][5:-1]
    assert number != "(988) 555-2485" and number in by[30]["text"] and by[31]["spans"] == "phone:5:19"
    joined = pii.pseudonymised(frame, "s", broadcast_entities=-1).collect()
    assert sorted(map(repr, joined)) == sorted(map(repr, out))
    assert pii.pseudonymised(empty_docs(spark), "s").count() == 0
