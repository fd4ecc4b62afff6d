"""Fill-in-the-middle: rotations against slicing, exact round trips, hard cases."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, docs_frame, empty_docs

from foreledger.llm import fim

TEXTS = st.text(st.sampled_from("aé漢👍<>PSM \n\x00"), max_size=60)


def plainly(text, key):
    """(output, form) by string slices."""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return text, "plain"
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", "spm"
    return f"<P>{prefix}<S>{suffix}<M>{middle}", "psm"


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(0, 10**6))
def test_outputs_and_round_trips(text, key):
    form, a, b = fim.drawn_form(text, key)
    output = bytes(fim.arrange(text, form, a, b)).decode()
    assert (output, form) == plainly(text, key)
    assert bytes(fim.restore(output, form)).decode() == text


@settings(max_examples=200, deadline=None)
@given(TEXTS.filter(lambda t: not any(s in t for s in ("<P>", "<S>", "<M>"))), st.data())
def test_every_form_and_cut_is_restored(text, data):
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(text)), st.integers(0, len(text)))))
    for form in ("psm", "spm"):
        assert bytes(fim.restore(bytes(fim.arrange(text, form, a, b)).decode(), form)).decode() == text


def test_rotation_over_many_blocks():
    rng = random.Random(3)
    for n in (0, 1, 2, fim.BLOCK - 1, 2 * fim.BLOCK, 3 * fim.BLOCK + 5):
        data = rng.randbytes(n)
        for m in {0, n // 3, n // 2, n}:
            buffer = bytearray(data)
            fim.rotate(buffer, 0, m, n)
            assert buffer == data[m:] + data[:m]


def test_cuts_of_a_long_text():
    text = "aé漢👍" * 50_000
    cuts = [0, 1, 2, 3, 65_535, 65_536, 131_073, 199_999, 200_000]
    assert fim.byte_cuts(text.encode(), cuts) == [len(text[:c].encode()) for c in cuts]


def test_cases(spark):
    more = [(30, "has <S> inside", "en"), (31, "<P>", "en"), (32, "<" * 50 + "S>", "en"), (33, "Ünï👍" * 9, "en")]
    rows = DOCS + more + [(k, "w<S x" * (k % 40), "en") for k in range(100, 400)]
    got = fim.restored(fim.transformed(docs_frame(spark, rows))).collect()
    assert sorted((str(r["doc_id"]), r["restored"]) for r in got) == sorted((str(i), t or "") for i, t, _ in rows)
    for r in got:
        assert (r["output"], r["form"]) == plainly(r["restored"], r["doc_id"])
        assert r["n"] == len(r["restored"]) and (r["prefix_chars"] is None) == (r["form"] == "plain")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.restored(fim.transformed(empty_docs(spark))).count() == 0
