"""Benchmark decontamination: short items searched inside long documents.

Item and document are sets of word shingles; an item is contained when the share of
its shingles that the document has reaches a threshold.  Items are partitioned by size;
the partition's upper bound sets how many of an item's smallest hashes form its MinHash
signature, just enough that a document with the wanted share must hold one of them.  So
the candidate search compares single minima with whole documents, has no false
negatives whatever the document's length, and each candidate is verified by counting
exact shingle texts.

Documents meet the signatures through bitmaps of a size fixed by parameters.  Only
shingles that pass are shuffled, salted, to the items.

Defined cases: a text of fewer words than a shingle is one shingle, so a short item is
found only in a document equal to it; a text without words holds nothing and is held
nowhere; rows that repeat an id and its text count once, and one id with several texts
counts as several documents (items alike); null ids and texts are allowed; columns other
than id and text are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreledger.llm.words import plain_words
from foreledger.sources.stored import stored

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
BITS_PER_SHINGLE = 64
MAX_BITMAP_BITS = 1 << 27
SALTS = 8
_MULTIPLIER = 0x9E3779B97F4A7C15
_PROBES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _hashes(words: list[str], width: int) -> np.ndarray:
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(_MULTIPLIER) + ids[k:len(ids) - width + 1 + k]
    return out ^ (out >> np.uint64(29))


def shingle_blocks(text: str | None, size: int) -> Iterator[tuple[list[str], int, np.ndarray]]:
    """(words, width, hashes) by block; shingle i is ``words[i:i + width]``."""
    carry: list[str] = []
    found = False
    for words in plain_words(text):
        words = carry + words
        if len(words) >= size:
            yield words, size, _hashes(words, size)
            found = True
            carry = words[len(words) - size + 1:]
        else:
            carry = words
    if carry and not found:
        yield carry, len(carry), _hashes(carry, len(carry))


def shingles_of(text: str | None, size: int = SHINGLE_WORDS) -> dict[int, str]:
    """Distinct shingles of a text by hash."""
    out: dict[int, str] = {}
    for words, width, hashes in shingle_blocks(text, size):
        values, first = np.unique(hashes, return_index=True)
        for h, i in zip(values.tolist(), first.tolist()):
            out.setdefault(h, " ".join(words[i:i + width]))
    return out


def signature_size(n: int, containment: float) -> int:
    """Hashes in the signature of an item of n shingles, set by its size partition.

    Partition p holds sizes up to ``2**p - 1``; of that many shingles a document with the
    wanted share can miss fewer than this.
    """
    upper = (1 << n.bit_length()) - 1
    return upper - ceil(containment * upper) + 1


def _item_rows(size: int, containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column(2)):
                found = shingles_of(text.as_py(), size)
                k = signature_size(len(found), containment)
                rows += [(at, len(found), h, found[h], nth < k) for nth, h in enumerate(sorted(found))]
            at, n, h, shingle, signed = zip(*rows) if rows else ((),) * 5
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(n, pa.int64()),
                 pa.array(np.array(h, np.uint64).astype(np.int64)), pa.array(shingle, pa.string()),
                 pa.array(signed, pa.bool_())], names=["item_id", "item_text", "n_item", "h", "shingle", "signed"])
    return run


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """Bloom bitmap of column ``h``, built by a bitwise-or aggregate; ``bits / 64`` rows at most reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate([_place(batch.column(0).to_numpy().astype(np.uint64), p, bits) for p in _PROBES])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["at"])

    word = F.shiftright("at", 6)
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    filled = (rows.select("h").mapInArrow(places, "at long").groupBy(word.alias("word")).agg(F.bit_or(bit).alias("set"))
              .toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[filled["word"].to_numpy()] = filled["set"].to_numpy()
    return out.view(np.uint8)


def _place(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (h * np.uint64(probe)) >> np.uint64(64 - (bits.bit_length() - 1))


def _in_bitmap(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Positions of ``h`` that pass every probe."""
    kept = np.arange(len(h))
    for p in _PROBES:
        at = _place(h[kept], p, len(bitmap) * 8)
        kept = kept[(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return kept


def _document_rows(signed, whole, size: int):
    """Shingles of documents that meet a signature, as far as any item may have them."""

    def hits(text: str | None) -> dict[int, str]:
        blocks = list(shingle_blocks(text, size)) if text and len(text) < 1 << 22 else None
        stream = lambda: blocks if blocks is not None else shingle_blocks(text, size)
        if not any(len(_in_bitmap(h, signed.value)) for _, _, h in stream()):
            return {}
        out: dict[int, str] = {}
        for words, width, h in stream():
            for i in _in_bitmap(h, whole.value).tolist():
                out.setdefault(int(h[i]), " ".join(words[i:i + width]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hs, texts = [], [], []
            for row, text in enumerate(batch.column(2)):
                found = hits(text.as_py())
                at += [row] * len(found)
                hs += found.keys()
                texts += found.values()
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(np.array(hs, np.uint64).astype(np.int64)), pa.array(texts, pa.string())],
                names=["doc_id", "doc_text", "h", "shingle"])
    return run


def contained_items(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text",
    containment: float = CONTAINMENT, size: int = SHINGLE_WORDS,
) -> DataFrame:
    """(doc_key, doc_text, item_key, n_item, n_shared, containment) of every contained item.

    ``doc_text`` is the XXH64 of the document's text: with the id it names the row.
    """
    def keyed(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key), F.xxhash64(F.col(text)), F.col(text))

    doc_type, item_type = (df.schema[k].dataType.simpleString() for df, k in ((docs, doc_key), (items, item_key)))
    index = stored(keyed(items, item_key).mapInArrow(
        _item_rows(size, containment),
        f"item_id {item_type}, item_text long, n_item long, h long, shingle string, signed boolean").distinct(), "items")
    wanted = BITS_PER_SHINGLE * max(index.count(), 1 << 10)
    bits = min(MAX_BITMAP_BITS, 1 << (wanted - 1).bit_length())
    share = docs.sparkSession.sparkContext.broadcast
    signed, whole = share(_bitmap(index.filter("signed"), bits)), share(_bitmap(index, bits))
    hits = keyed(docs, doc_key).mapInArrow(
        _document_rows(signed, whole, size), f"doc_id {doc_type}, doc_text long, h long, shingle string")
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_text"), F.lit(SALTS)))
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = salted.join(copies, ["h", "shingle", "salt"]).groupBy(
        "doc_id", "doc_text", "item_id", "item_text", "n_item", "h").agg(F.max("signed").alias("signed"))
    counted = met.groupBy("doc_id", "doc_text", "item_id", "item_text", "n_item").agg(
        F.count("*").alias("n_shared"), F.max("signed").alias("candidate"))
    share_of = F.col("n_shared") / F.col("n_item")
    return counted.filter(F.col("candidate") & (share_of >= containment)).select(
        F.col("doc_id").alias(doc_key), "doc_text", F.col("item_id").alias(item_key), "n_item", "n_shared",
        share_of.alias("containment"))


def decontaminated(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text",
) -> DataFrame:
    """Rows of ``docs`` that contain no item."""
    found = contained_items(docs, items, doc_key, item_key, text).select(
        F.col(doc_key).alias("__id"), F.col("doc_text").alias("__text")).distinct()
    same = F.col(doc_key).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__text"))
    return docs.join(found, same, "left_anti")
