"""Importance resampling: payloads, composition, and whole results against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, docs_frame, empty_docs

from foreledger.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plainly(docs, target, n=1, buckets=10_000, share=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in plain_features(x, n)) for texts in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    rows = []
    for key, text in docs:
        f = plain_features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        rows.append([key, len(plain_features(text, 1)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:share * len(able) // 100], 1):
        r[5] = k
    return rows


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB1é漢 ,\n\x00-Z_{"), max_size=80), st.sets(st.integers(0, 40)), st.integers(1, 4))
def test_scans_equal_plain_features(text, chosen, n):
    words = sorted({w.encode() for w in plain_features(text, 1)})
    known = importance.automaton([w for k, w in enumerate(words) if k in chosen])
    got = [importance.features(text, known, 1 << 32, n)]
    assert collections.Counter(x for part in got for found in part for x in found.tolist()) == collections.Counter(
        zlib.crc32(f.encode()) for f in plain_features(text, n))


def test_blocks_carry_runs_over(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 16)
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcé", k=rng.randint(1, 30))) for _ in range(300))
    known = importance.automaton(sorted({w.encode() for w in text.split()})[::2])
    for n in (1, 2, 3):
        got = collections.Counter(x for found in importance.features(text, known, 1 << 32, n) for x in found.tolist())
        assert got == collections.Counter(zlib.crc32(f.encode()) for f in plain_features(text, n))


def test_shift_composes_checksums():
    rng = random.Random(4)
    for _ in range(200):
        a, b = rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 300))
        shifted = importance._shifted(np.array([zlib.crc32(a)]), np.array([len(b)]))
        assert shifted[0] ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_whole_results(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)] + ["été", "漢字"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for k in range(300)] + [(i, t) for i, t, _ in DOCS]
    docs += [(7, "same " * 30), (7, "same " * 30), (None, "x " * 25)]
    target = ["w1 w2 w3 W4", None, "", "été été w5", "w1 w2"]
    items = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, score int")
    frame = docs_frame(spark, [(i, t, "en") for i, t in docs]).selectExpr("*", "1 AS rank", "2 AS score", "3 AS n_words")
    for n, size in ((1, 50), (2, 1 << 16), (1, 0)):
        got = importance.resampled(frame, items, max_ngram=n, dictionary_words=size)
        want = plainly(docs, target, n)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want)))
    left = importance.drawn(frame, got)
    assert left.columns == frame.columns and {r["doc_id"] for r in left.collect()} == {r[0] for r in want if r[5]}


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert importance.resampled(empty_docs(spark), items).count() == 0
    got = importance.resampled(docs_frame(spark), items.filter("false")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, plainly([(i, t) for i, t, _ in DOCS], []))))
