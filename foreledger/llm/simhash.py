"""SimHash near-duplicates: exact search among 64-bit fingerprints.

A fingerprint takes the majority of every bit over the XXH64 hashes (seed 42) of a
text's word shingles.  Two fingerprints within ``radius`` bits agree on at least two of
``radius + 2`` blocks, so distinct fingerprints are put in buckets by every pair of
blocks and no link is lost.  A bucket is cut into tiles by population count and hash;
tile pairs whose population counts differ by more than the radius are skipped, the
others are compared in full with numpy exclusive-or and bit counts.

Defined cases: a null or wordless text has fingerprint zero and is linked like any
other; a text shorter than a shingle hashes as a whole; a null id keeps its row and
never names a component with another id in it; equal texts share a fingerprint, so
repeated rows cost nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.llm.components import components
from foreledger.llm.words import byte_words
from foreledger.sources.stored import stored

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
TILE_ROWS = 1024
BAND_BITS = 8
CROSS_ROWS = 1 << 21


def _bit_sums(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """Sums of the 64 bits over all shingles of a word list that has one at least."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest, width = xxhash.xxh64_intdigest, shingle - 1
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[width:].tolist())), np.uint64, len(words) - width)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64), len(hashes)


def fingerprint_of(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a whole text as an unsigned 64-bit number."""
    sums, n, carry = np.zeros(64, np.int64), 0, []
    for words in byte_words(text, lower=True):
        words = carry + words
        if len(words) >= shingle:
            more, k = _bit_sums(words, shingle)
            sums, n = sums + more, n + k
            carry = words[len(words) - shingle + 1:]
        else:
            carry = words
    if n == 0 and carry:
        sums, n = _bit_sums(carry, len(carry))
    return int(sum(1 << k for k in np.flatnonzero(2 * sums > n).tolist()))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one row per row of ``docs``; ``fp`` holds the bits as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t.as_py()) for t in batch.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[key, "fp"])

    rows = docs.select(F.col(key), F.col(text))
    return rows.mapInArrow(hashed, f"`{key}` {rows.schema[0].dataType.simpleString()}, fp long")


def _masks(radius: int) -> list[int]:
    """Bit masks, as signed longs, of every pair of ``radius + 2`` blocks."""
    parts = radius + 2
    edges = [64 * k // parts for k in range(parts + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in (a | b for a, b in combinations(block, 2))]


def _crossed(left: pa.ListArray, right: pa.ListArray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (a, b) within the radius, over every row's left tile against its right tile."""
    a, b = left.values.to_numpy(), right.values.to_numpy()
    from_a, from_b = left.offsets.to_numpy().astype(np.int64), right.offsets.to_numpy().astype(np.int64)
    n_a, n_b = np.diff(from_a), np.diff(from_b)
    total = np.cumsum(n_a * n_b)
    us, vs, row = [], [], 0
    while row < len(total):
        done = total[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(total, done + CROSS_ROWS, "right")))
        sizes = (n_a * n_b)[row:stop]
        of = np.repeat(np.arange(row, stop), sizes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        x, y = a[from_a[of] + nth // n_b[of]], b[from_b[of] + nth % n_b[of]]
        near = np.flatnonzero(np.bitwise_count((x ^ y).view(np.uint64)) <= radius)
        us.append(x[near])
        vs.append(y[near])
        row = stop
    return np.concatenate(us), np.concatenate(vs)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, root) that join values as the links (u, v) do."""
    values, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = place[:len(u)], place[len(u):]
    root = np.arange(len(values))
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = _forest(*_crossed(batch.column(0), batch.column(1), radius))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
    return run


def linked_pairs(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (u, v) over a column ``fp`` of distinct fingerprints.

    They connect exactly the fingerprints that chains of links connect; the links of a
    batch of tile pairs are reduced to a forest, so a dense group gives no square of edges.
    """
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(radius)])
    keyed = distinct.select("fp", F.posexplode(keys).alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    pop = F.bit_count("fp")
    members = keyed.join(shared, ["t", "key"]).select(
        "t", "key", "fp", pop.alias("pop"), F.floor(pop / BAND_BITS).alias("band"),
        F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile_rows)).alias("part"))
    tiles = stored(members.groupBy("t", "key", "band", "part").agg(
        F.collect_list("fp").alias("fps"), F.min("pop").alias("lo"), F.max("pop").alias("hi")), "tiles")
    right = tiles.select("t", "key", *[F.col(c).alias(f"{c}_r") for c in ("band", "part", "fps", "lo", "hi")])
    ordered = (F.col("band") < F.col("band_r")) | ((F.col("band") == F.col("band_r")) & (F.col("part") <= F.col("part_r")))
    near = (F.col("lo_r") - F.col("hi") <= radius) & (F.col("lo") - F.col("hi_r") <= radius)
    pairs = tiles.join(right, ["t", "key"]).filter(ordered & near).select("fps", "fps_r")
    return pairs.mapInArrow(_compare(radius), "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(key, fp, component_id) of every row; the least key reachable over links."""
    marked = stored(fingerprints(docs, key, text), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min(key).alias("first_id")), "distinct")
    roots = components(linked_pairs(distinct.select("fp"), radius, tile_rows))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(placed.join(named, "root").select("fp", "component_id"), "fp").select(
        key, "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` that stand for their group: those whose id names the component.

    Of rows that repeat both id and text one stays.  Rows with a null id stay only if
    their whole group has none.
    """
    found = near_duplicates(docs, key, text, radius)
    kept = found.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(
        F.col(key).alias("__kept")).distinct()
    rows = docs.join(kept, F.col(key).eqNullSafe(F.col("__kept")), "left_semi")
    return first_of_repeats(rows, key, text)


def first_of_repeats(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One of the rows that have the same id and text."""
    from pyspark.sql import Window

    same = Window.partitionBy(key, F.md5(text)).orderBy(F.lit(1))
    return rows.withColumn("__nth", F.row_number().over(same)).filter("__nth = 1").drop("__nth")
