"""Fill-in-the-middle: move a document's middle or suffix by rotating blocks in place.

Two hashed cuts split a text into prefix, middle and suffix.  The cuts are found by one
scan over the UTF-8 bytes, sentinels are inserted into a bytearray at the cuts, and two
neighbouring segments change places by a rotation made of three reversals, so nothing but
the bytearray and a block of fixed size is held.  The inverse finds the sentinels, rotates
back and deletes them; it needs only the output and its form.  No sentinel overlaps itself
or another one, so one that is found is one that was inserted.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``,
``plain`` is the text itself.

Defined cases: a null text counts as empty; an empty text and one that holds a sentinel
are plain; a null id hashes like an empty one; rows are treated one by one, so repeated
rows and ties need no rule and equal rows give equal results; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "1"
PLAIN_FROM = 90
SPM_BELOW = 20
BLOCK = 1 << 16


def _reverse(view: np.ndarray, a: int, b: int) -> None:
    """Reverse view[a:b] in place, a block from either end at a time."""
    while b - a > 1:
        k = min(BLOCK, (b - a) // 2)
        head = view[a:a + k].copy()
        view[a:a + k] = view[b - k:b][::-1]
        view[b - k:b] = head[::-1]
        a, b = a + k, b - k


def rotate(buffer: bytearray, a: int, m: int, b: int) -> None:
    """Exchange buffer[a:m] and buffer[m:b] in place by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, a, m)
    _reverse(view, m, b)
    _reverse(view, a, b)


def byte_cuts(data: bytes | bytearray, cuts: list[int]) -> list[int]:
    """Byte offsets of rising code point offsets."""
    view, out, seen, at = np.frombuffer(data, np.uint8), [], 0, 0
    todo = list(cuts)
    while todo and at < len(view):
        starts = np.flatnonzero((view[at:at + BLOCK] & 0xC0) != 0x80)
        while todo and todo[0] < seen + len(starts):
            out.append(at + int(starts[todo.pop(0) - seen]))
        seen, at = seen + len(starts), at + BLOCK
    return out + [len(view)] * len(todo)


def drawn_form(text: str, key: int | None, seed: str = SEED) -> tuple[str, int, int]:
    """(form, first cut, second cut) of a text, in code points."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    cuts = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    marked = any(s.decode() in text for s in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or h[2] % 100 >= PLAIN_FROM:
        return "plain", *cuts
    return "spm" if h[3] % 100 < SPM_BELOW else "psm", *cuts


def arrange(text: str, form: str, first: int, second: int) -> bytes | bytearray:
    """UTF-8 of the text in the given form."""
    data = text.encode("utf-8", "surrogatepass")
    if form == "plain":
        return data
    a, b = byte_cuts(data, [first, second])
    buffer = bytearray(data)
    for at, sentinel in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restore(output: str, form: str) -> bytes | bytearray:
    """UTF-8 of the text that :func:`arrange` was given."""
    data = output.encode("utf-8", "surrogatepass")
    if form == "plain":
        return data
    buffer = bytearray(data)
    if form == "psm":
        start = buffer.index(SUFFIX)
        turn = buffer.index(MIDDLE, start)
    else:
        start, turn = 0, buffer.index(PREFIX)
    rotate(buffer, start, turn, len(buffer))
    suffix = start + len(buffer) - turn
    middle = buffer.index(MIDDLE)
    for at, sentinel in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buffer[at:at + len(sentinel)]
    return buffer


def _strings(parts: list) -> pa.Array:
    """Byte strings, known to be UTF-8, as a column of strings."""
    return pa.array([bytes(p) for p in parts], pa.binary()).cast(pa.string())


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, forms, prefix, middle, out = [], [], [], [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                form, first, second = drawn_form(body, name, seed)
                plain = form == "plain"
                n.append(len(body))
                forms.append(form)
                prefix.append(None if plain else first)
                middle.append(None if plain else second - first)
                out.append(arrange(body, form, first, second))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), _strings(out)],
                names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """``outputs`` with one more column: the texts that were transformed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(o.as_py(), f) for o, f in zip(batch.column(output), batch.column(form).to_pylist())]
            yield batch.append_column(to, _strings(texts))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema)
    return outputs.mapInArrow(run, f"{fields}, `{to}` string")


def text_digest(text: str) -> Column:
    """Lowercase hex SHA-256 of a column's UTF-8."""
    return F.sha2(F.col(text), 256)
