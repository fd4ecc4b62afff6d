"""Importance resampling towards a target: hashed n-gram features found by an automaton.

Texts are lower-cased in A-Z, every delimiter becomes one space, and a word is then a run
between spaces.  The most frequent distinct words of source and target form a dictionary:
an Aho-Corasick automaton over space-bounded words whose payload packs a word's CRC-32 and
byte length.  One scan of a text emits the payloads of its words; the gaps between them
hold the words outside the dictionary, whose payloads are computed, so the dictionary
bounds memory and time and never changes a result.  CRC-32 is linear, so the CRC of
neighbouring words joined by spaces is composed from their payloads without their bytes.

The same scan serves counting (bucket totals, summed per task before they are shuffled) and
scoring.  Only totals by bucket reach the driver: their number is a parameter.  Ranks come
from one range-partitioned sort of (score, id); offsets are sums by partition.

Defined cases: a null text has no words, weight 0 and is never drawn, like every text with
fewer than ``min_words`` words; a null id hashes like an empty one and sorts last among
equal scores; rows that repeat are rows of their own, and of rows equal in score and id any
order may stand; very long texts are scanned block by block; other columns are ignored; an
empty target or source counts as zero totals; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.sources.stored import drop_stored, stored

BUCKETS = 10_000
MAX_NGRAM = 1
MIN_WORDS = 20
SHARE = 10
SEED = "2024"
#: The dictionary holds at most so many words, none longer than so many bytes.
DICTIONARY_WORDS = 1 << 16
WORD_BYTES = 64
LEVELS = 64
BLOCK = 1 << 20
#: Letters and digits in lower case, bytes of longer characters as they are, all others a space.
_PLAIN = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def blocks(text: str | None) -> Iterator[bytes]:
    """A text's words between single bytes of space, in blocks that end between words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield b" " + data[at:end] + b" "
        at = end


def payload(word: bytes) -> int:
    """CRC-32 in the low 32 bits, byte length above."""
    return len(word) << 32 | zlib.crc32(word)


def automaton(words: list[bytes]):
    """Aho-Corasick automaton of space-bounded words; None without words.

    Bytes are searched as Latin-1 characters, so positions are bytes.
    """
    import ahocorasick

    if not words:
        return None
    found = ahocorasick.Automaton()
    for word in words:
        found.add_word(f" {word.decode('latin-1')} ", payload(word))
    found.make_automaton()
    return found


def payloads(block: bytes, known) -> np.ndarray:
    """Payloads of the words of a block, in order."""
    if known is None:
        return np.array([payload(w) for w in block.split()], np.int64)
    hits = np.fromiter(chain.from_iterable(known.iter(block.decode("latin-1"))), np.int64)
    ends, values = hits[::2], hits[1::2]
    # A gap runs from the space that ends one known word to the one that opens the next.
    closes = np.concatenate([[0], ends])
    opens = np.concatenate([ends - (values >> 32) - 1, [len(block) - 1]])
    at, extra = [], []
    gaps = np.flatnonzero(opens - closes > 1)
    for k, a, b in zip(gaps.tolist(), closes[gaps].tolist(), opens[gaps].tolist()):
        unknown = block[a:b].split()
        at += [k] * len(unknown)
        extra += map(payload, unknown)
    return np.insert(values, at, extra) if extra else values


@lru_cache(maxsize=4096)
def _shift(n_bytes: int) -> np.ndarray:
    """What ``n_bytes`` zero bytes make of each byte of a CRC: 4 tables of 256 values.

    ``crc(a + b) = shift(crc(a)) ^ crc(b)``; the shift is linear, so a table for each of
    the four bytes suffices.  Columns are found by squaring the one-bit operator.
    """
    step = [0xEDB88320] + [1 << k for k in range(31)]  # image of every bit under one zero bit
    apply = lambda matrix, v: _xor(matrix[k] for k in range(32) if v >> k & 1)
    whole, n_bits = [1 << k for k in range(32)], 8 * n_bytes
    while n_bits:
        if n_bits & 1:
            whole = [apply(step, v) for v in whole]
        step = [apply(step, v) for v in step]
        n_bits >>= 1
    return np.array([[apply(whole, b << 8 * k) for b in range(256)] for k in range(4)], np.int64)


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def _shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.empty_like(crc)
    for n in np.unique(lengths).tolist():
        at, tables = lengths == n, _shift(n)
        c = crc[at]
        out[at] = tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]
    return out


def feature_crcs(words: np.ndarray, max_ngram: int = MAX_NGRAM) -> Iterator[np.ndarray]:
    """CRCs of all runs of 1, 2, ... words, composed from the words' payloads."""
    crc, length = words & 0xFFFFFFFF, words >> 32
    run, space = crc, zlib.crc32(b" ")
    yield run
    for n in range(2, max_ngram + 1):
        run = _shifted(run[:-1], np.ones(max(len(run) - 1, 0), np.int64)) ^ space
        run = _shifted(run, length[n - 1:]) ^ crc[n - 1:]
        yield run


def features(text: str | None, known, n_buckets: int = BUCKETS, max_ngram: int = MAX_NGRAM) -> Iterator[np.ndarray]:
    """Buckets of a text's features, some at a time; first of all runs that end in a block."""
    carry = np.zeros(0, np.int64)
    for block in blocks(text):
        words = payloads(block, known)
        both = np.concatenate([carry, words])
        for n, crcs in enumerate(feature_crcs(both, max_ngram), 1):
            yield crcs[max(0, len(carry) - n + 1):] % n_buckets
        carry = both[max(0, len(both) - max_ngram + 1):] if max_ngram > 1 else carry


def dictionary(texts: DataFrame, column: str = "text", size: int = DICTIONARY_WORDS) -> list[bytes]:
    """The most frequent distinct words of all texts, at most ``size``; every word is counted.

    Counts are graded by their logarithm.  The top grades that fit are taken whole, so that
    no task and not the driver ever holds more words than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                for block in blocks(text.as_py()):
                    seen.update(block.split())
            words = [w for w in seen if len(w) <= WORD_BYTES]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])

    counts = stored(texts.select(column).mapInArrow(run, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n") * LEVELS)), "words")
    room, least = size, None
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 64 * LEVELS rows
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    found = [] if least is None else [bytes(r["word"]) for r in counts.filter(F.col("level") >= least).collect()]
    drop_stored(counts)
    return sorted(found)


_last: tuple = (None, None)


def _known(words: Broadcast):
    """The automaton of a broadcast dictionary, built once in a worker; the last one stays."""
    global _last
    if _last[0] is not words.value:
        _last = (words.value, automaton(words.value))
    return _last[1]


def totals(
    texts: DataFrame, words: Broadcast, column: str = "text", n_buckets: int = BUCKETS, max_ngram: int = MAX_NGRAM,
) -> DataFrame:
    """(bucket, n): features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = _known(words), np.zeros(n_buckets, np.int64)
        for batch in batches:
            parts, held = [], 0
            for text in batch.column(0):
                for found in features(text.as_py(), known, n_buckets, max_ngram):
                    parts.append(found)
                    held += len(found)
                    if held > BLOCK:
                        sums += np.bincount(np.concatenate(parts), minlength=n_buckets)
                        parts, held = [], 0
            if parts:
                sums += np.bincount(np.concatenate(parts), minlength=n_buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    return texts.select(column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): smoothed log ratio of target to source frequency, in thousandths, floored."""
    spark = source.sparkSession
    s, t = (frame.select("bucket", F.col("n").alias(c)) for frame, c in ((source, "s"), (target, "t")))
    every = spark.range(n_buckets).withColumnRenamed("id", "bucket")
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + float(n_buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(n_buckets)))
    return both.crossJoin(F.broadcast(sums)).select(  # one row of sums
        "bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(
    docs: DataFrame, words: Broadcast, gain: Broadcast, key: str = "doc_id", text: str = "text", max_ngram: int = MAX_NGRAM,
) -> DataFrame:
    """(key, n_words, n_features, weight) of every row."""
    rows = docs.select(F.col(key), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = _known(words), gain.value
        for batch in batches:
            n_word, n_feature, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for k, body in enumerate(batch.column(1)):
                for nth, found in enumerate(features(body.as_py(), known, len(of), max_ngram)):
                    n_word[k] += len(found) if nth % max_ngram == 0 else 0
                    n_feature[k] += len(found)
                    weight[k] += of[found].sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_word), pa.array(n_feature), pa.array(weight)],
                names=[key, "n_words", "n_features", "weight"])

    return rows.mapInArrow(
        run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(key: str, seed: str = SEED) -> Column:
    """Seeded Gumbel noise of a row's key, in thousandths, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, key: str, eligible: Column, share: int = SHARE) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the drawn share of eligible rows, else null."""
    rows = stored(scored.select(
        "*", eligible.alias("may_draw"), F.monotonically_increasing_id().alias("row_no")), "scored")
    n_drawn = rows.agg(F.count_if("may_draw").alias("n")).first()["n"] * share // 100
    order = [F.desc("may_draw"), F.desc("score"), F.asc_nulls_last(key), F.asc("row_no")]
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id()), "placed")
    drop_stored(rows)
    part = F.shiftrightunsigned("place", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect()))  # a row for each partition
    before, offsets = 0, []
    for part_no, n in sizes:
        offsets.append((part_no, before))
        before += n
    spark = scored.sparkSession
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("part", part).join(starts, "part").withColumn(
        "rank", F.when(F.col("may_draw") & (rank <= n_drawn), rank)).drop("part", "before", "place", "row_no", "may_draw")


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    n_buckets: int = BUCKETS, max_ngram: int = MAX_NGRAM, min_words: int = MIN_WORDS, share: int = SHARE, seed: str = SEED,
    dictionary_words: int = DICTIONARY_WORDS,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of ``docs``."""
    spark = docs.sparkSession
    bodies = docs.select(F.col(text).alias("text"))
    wanted = target.select(F.col(target_text).alias("text"))
    words = spark.sparkContext.broadcast(dictionary(bodies.unionByName(wanted), size=dictionary_words))
    source, aim = (totals(d, words, "text", n_buckets, max_ngram) for d in (bodies, wanted))
    gain = np.zeros(n_buckets, np.int64)
    for r in gains(source, aim, n_buckets).collect():  # a row for each bucket
        gain[r["bucket"]] = r["gain"]
    found = weighed(docs, words, spark.sparkContext.broadcast(gain), key, text, max_ngram)
    scored = found.withColumn("score", F.col("weight") + gumbel(key, seed))
    return ranked(scored, key, F.col("n_words") >= min_words, share)


def drawn(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id was drawn; rows that share an id go together."""
    ids = found.filter("rank IS NOT NULL").select(F.col(key).alias("drawn_id")).distinct()
    mine = F.col("docs_in." + key)
    return docs.alias("docs_in").join(ids.alias("ids_in"), mine.eqNullSafe(F.col("ids_in.drawn_id")), "left_semi")
