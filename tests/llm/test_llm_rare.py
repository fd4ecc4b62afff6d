"""Language models of rare and copied languages, and of more n-grams than a bound."""

import random
import zlib

import numpy as np
import pytest
from llm_cases import docs_frame

from foreledger.llm import langid

LETTERS = {"aa": "abcdefghij", "bb": "klmnopqrst", "cc": "абвгдежзик", "dd": "лмнопрстуф", "ee": "αβγδεζηθικ"}


def fold(i):
    return zlib.crc32(str(i).encode()) % langid.FOLDS


def corpus():
    """Three big languages, "dd" of three documents, one a fold, and "ee" of copies of two texts."""
    rng = random.Random(4)
    lexicon = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 7))) for _ in range(40)] for k, v in LETTERS.items()}
    text = lambda k, n: " ".join(rng.choice(lexicon[k]) for _ in range(n))
    rows = [(i, text(k, rng.randint(40, 90)), k) for i, k in enumerate(["aa", "bb", "cc"] * 150)]
    ids = iter(range(1000, 2000))
    wanted = [0, langid.HELD_FOLD, langid.CALIBRATION_FOLD]
    rows += [(next(i for i in ids if fold(i) == f), text("dd", 60), "dd") for f in wanted]
    copies = [text("ee", 60), text("ee", 60)]
    rows += [(next(ids), copies[0], "ee") for _ in range(40)] + [
        (next(i for i in ids if fold(i) in (0, 1)), copies[1], "ee"),
        (next(i for i in ids if fold(i) == langid.HELD_FOLD), text("ee", 60), "ee")]
    return rows


def test_rare_and_copied_languages_are_not_rejected(spark):
    rows = corpus()
    docs = docs_frame(spark, rows)
    model = langid.fit(docs)
    told = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for lang in LETTERS:
        ids = [i for i, _, k in rows if k == lang]
        assert sum(told[i]["rejected"] for i in ids) <= len(ids) // 100, lang
    strange = spark.createDataFrame([(1, "ሀለሐመ ሠረሰሸ ቀበተቸ ኀነኘአ " * 20)], "doc_id long, text string")
    assert langid.predict(strange, model).first()["rejected"]


def test_shrunk_values():
    own, kinds = np.array([2.0, 2.2, 1.0, 0.0]), np.array([1000, 1000, 1, 0])
    mean, spread = langid._shrunk(own, kinds, np.array([999.0, 999.0, 0.0, 0.0]))
    assert mean[0] == pytest.approx(2.0, abs=0.01) and spread[0] == pytest.approx(1, rel=0.8)
    assert mean[2] > 1.6 and mean[3] == pytest.approx(5.2 / 3) and (spread[2:] >= spread[:2].max()).all()


def test_a_model_counts_every_gram(spark, monkeypatch):
    monkeypatch.setattr(langid.most_frequent, "__defaults__", (300,))
    docs = docs_frame(spark, corpus())
    counts = langid.gram_counts(docs, "doc_id", "text", "lang").toPandas()
    model, whole = langid.fit(docs), langid.build_model(counts)
    assert model.langs == whole.langs and len(model.grams[-1].hashes) == counts["gram"].nunique() > 300
    assert (model.grams[-1].values == whole.grams[-1].values).all()
