"""The pipeline's near-duplicate stage against exact five-word similarity."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from llm_cases import DOCS, docs_frame, empty_docs, words  # noqa: E402

from foreledger.llm import neardup  # noqa: E402


def five(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    return len(five(a) & five(b)) / max(len(five(a) | five(b)), 1)


def test_near_copies_go_and_unlike_texts_stay(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, originals = [], []
    for k in range(40):
        base = fresh(200)
        near, half = list(base), list(base)
        for at in rng.sample(range(10, 190), 1 + k % 4):
            near[at] = "changed"
        half[90:] = fresh(110)
        assert similarity(" ".join(base), " ".join(near)) >= 0.8 > 0.6 > similarity(" ".join(base), " ".join(half))
        originals += [3 * k, 3 * k + 2]
        rows += [(3 * k, " ".join(base), "en"), (3 * k + 1, " ".join(near), "en"), (3 * k + 2, " ".join(half), "en")]
    frame = docs_frame(spark, rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(originals)


def test_components_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for k in range(12):
        text = [f"t{k}x{i}" for i in range(60)]
        for step in range(10):
            rows.append((len(rows), " ".join(text), "en"))
            text = list(text)
            text[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_frame(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == root


def test_near_cases(spark):
    rows = DOCS + [(50, "same id", "en"), (60, "other text here", "en"), (60, "same id", "en"), (None, "alone a", "en"), (None, "alone b", "en")]
    left = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(docs_frame(spark, rows)).collect()]
    ids = [i for i, _ in left]
    assert {1, 2, 5, 7, 8, 9, 50, 60} <= set(ids) and not {3, 4} & set(ids) and ids.count(1) == 1
    assert ids.count(60) == 1 and sorted(t for i, t in left if i is None) == ["alone a", "alone b"]
    assert neardup.deduplicated(empty_docs(spark)).count() == 0


def test_a_shared_passage_makes_no_square(spark):
    """400 texts with one 60-word passage, all under the threshold: no pair is compared in full."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([f"a{rng.randrange(10**6)}" for _ in range(6)] + passage + [f"b{rng.randrange(10**6)}" for _ in range(6)]), "en")
            for k in range(400)]
    sample = [similarity(rows[i][1], rows[j][1]) for i in range(0, 400, 40) for j in range(i)]
    assert 0.6 < max(sample) < 0.8
    marked = neardup.stored(neardup._marked(docs_frame(spark, rows), "doc_id", "text"))
    nodes = marked.select("node", "size", "sketch", marked["node"].alias("root")).selectExpr("*", "1L AS bucket")
    assert neardup._across(nodes, 0.8, 64).count() <= 400
    assert neardup.linked(docs_frame(spark, rows), marked, "text").count() == 0


def test_sketches_drop_no_pair_and_tiles_none(spark):
    rng = random.Random(12)
    base, rows = [f"t{i}" for i in range(80)], []
    for k in range(150):
        text = list(base)
        for at in rng.sample(range(80), rng.randrange(5)):
            text[at] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(text), "en"))
    marked = neardup.stored(neardup._marked(docs_frame(spark, rows), "doc_id", "text"))
    node = {r["doc_id"]: r["node"] for r in marked.collect()}
    nodes = marked.select("node", "size", "sketch", marked["node"].alias("root")).distinct().selectExpr("*", "1L AS bucket")
    texts = {node[i]: t for i, t, _ in rows}
    want = {(max(a, b), min(a, b)) for a in texts for b in texts if a < b and similarity(texts[a], texts[b]) >= 0.8}
    for tile in (1024, 16):
        got = {tuple(r) for r in neardup._across(nodes, 0.8, tile).collect()}
        assert want <= got and len(got) < 1.2 * len(want)
    stars = {tuple(r)[:2] for r in neardup._bounded(spark.createDataFrame(sorted(want), "u long, v long"), nodes, 0.8).collect()}
    assert stars == want


def test_the_stage_takes_the_links_of_simhash(spark):
    """Equal fingerprints without a common five-word shingle: the stage drops one, similarity alone keeps both."""
    rows = [(1, "a b a", "en"), (2, "a b a b a b a", "en"), (3, " ".join(f"c{k}" for k in range(30)), "en")]
    frame = docs_frame(spark, rows)
    assert similarity(rows[0][1], rows[1][1]) == 0
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in neardup.deduplicated(frame).collect()) == [1, 2, 3]
