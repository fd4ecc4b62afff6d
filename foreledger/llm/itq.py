"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Distinct vectors of a label are nodes.  A rotation that makes the signs of the rotated
vectors a balanced code (principal axes, then iterative quantisation) is fitted on a bounded
hash sample of nodes; every node is then coded and indexed.  The code is cut into blocks,
one table a block, as many as the largest label group needs for keys of log2(n) bits.  A node
stands in a table under its own key and looks there under every key that differs only in
bits it is unsure of: the block's smallest margins.  Vectors at cosine 0.98 differ by at most
0.2 in any rotated coordinate and flip mostly such bits; a pair is missed only if it escapes
all tables from both sides.

A pair that meets is owned by one bucket: that of the first table in which either finds the
other, under the key of the lesser node if both do.  So every link is counted once without
a pair ever being written.  Buckets are first compared by code alone; only nodes that own a
pair within the Hamming radius there bring their vectors, tile by tile, and cosines in
double precision decide.  Buckets larger than a tile are cut by node hash into tiles, and
each pair of tiles is a group of its own.  What leaves a task is a count for each node and
a forest of its links, never a square of pairs.

Defined cases: a null, zero or non-finite vector, or one with a null component or a null
label, links with nothing; vectors of different length are never compared; equal vectors of
one label are one node and link with each other; a null id counts as a partner, keeps its
row and never names a component with another id in it; rows that repeat an id are rows of
their own and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.llm.components import components
from foreledger.llm.simhash import _forest
from foreledger.sources.stored import drop_stored, stored

SIMILARITY = 0.98
CODE_BITS = 64
SAMPLE_ROWS = 1 << 14
ITERATIONS = 50
SEED = 42
#: Vectors in a tile take at most so many bytes; tiles hold 64 to 2048 vectors.
TILE_BYTES = 1 << 20
#: Unsure bits of a block by number of tables.
UNSURE = {1: 10, 2: 6, 3: 4, 4: 3, 5: 3, 6: 2, 7: 2, 8: 2}
CROSS_ROWS = 1 << 21
_BUCKET = ["label", "dim", "t", "key"]


def radius(bits: int) -> int:
    """Hamming radius of candidates: 16 of 64 bits, six deviations above what 0.98 flips."""
    return min(bits, 8 + bits // 8)


def table_edges(bits: int, largest: int) -> list[int]:
    """Block borders for label groups of at most ``largest`` nodes."""
    width = max(8, math.ceil(math.log2(max(largest, 2))))
    tables = max(min(2, bits // 8), min(8, bits // width), 1)
    return [bits * k // tables for k in range(tables + 1)]


def fit_rotation(sample: np.ndarray, bits: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): projections ``(x - mean) @ axes`` whose signs are the code.

    The axes are orthonormal, so projections of two vectors are never further apart than
    the vectors are.
    """
    d = sample.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    x = sample - mean
    main = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]
    v = x @ main
    for _ in range(ITERATIONS if len(sample) else 0):
        left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return mean, main @ turn


def unit_matrix(column: pa.ListArray, d: int | None = None) -> np.ndarray:
    """Vectors, none of them zero, at length 1 in double precision, cut or filled to d components."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    d = int(lengths[0]) if d is None and len(lengths) else d or 0
    if (lengths == d).all():
        out = flat.reshape(len(lengths), d)
        out = out / np.abs(out).max(axis=1, keepdims=True, initial=0)
        return out / np.sqrt((out * out).sum(axis=1, keepdims=True))
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    top = np.zeros(len(lengths))
    np.maximum.at(top, row, np.abs(flat))
    flat = flat / top[row]
    flat = flat / np.sqrt(np.bincount(row, flat * flat, len(lengths)))[row]
    out, fits = np.zeros((len(lengths), d)), place < d
    out[row[fits], place[fits]] = flat[fits]
    return out


def _masks(edges: list[int]) -> np.ndarray:
    return np.array([((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])], np.uint64)


def encode(projected: np.ndarray, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, unsure) of every row: sign bits, and the bits of smallest margin in each block."""
    bit = np.uint64(1) << np.arange(projected.shape[1], dtype=np.uint64)
    code = ((projected >= 0) * bit).sum(axis=1, dtype=np.uint64)
    unsure = np.zeros(len(code), np.uint64)
    for a, b in zip(edges, edges[1:]):
        k = min(UNSURE[len(edges) - 1], b - a)
        least = np.argsort(np.abs(projected[:, a:b]), axis=1, kind="stable")[:, :k]
        unsure |= bit[a:b][least].sum(axis=1, dtype=np.uint64)
    return code, unsure


def probe_keys(code: np.ndarray, unsure: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Keys of a table in which a node looks, one column each; the first is its own."""
    keys, left = (code & mask)[:, None], unsure & mask
    while left.any():
        low = left & (~left + np.uint64(1))
        keys = np.concatenate([keys, keys ^ low[:, None]], axis=1)
        left ^= low
    return keys


def _owned(t, masks, a, b) -> np.ndarray:
    """Whether pairs that meet in a bucket of table t are owned by it.

    ``a`` and ``b`` are (node, code, unsure, home) of either side; one is at home.
    """
    diff, ok = a[1] ^ b[1], np.ones(len(a[0]), bool)
    reaches = lambda side, mask: (diff & mask & ~side[2]) == 0
    for s in range(len(masks)):
        earlier = s < t
        if np.any(earlier):
            ok &= ~(earlier & (reaches(a, masks[s]) | reaches(b, masks[s])))
    here = masks[t]
    ok &= a[3] | ~b[3] | ~reaches(b, here) | (b[0] < a[0])
    ok &= b[3] | ~a[3] | ~reaches(a, here) | (a[0] < b[0])
    return ok & (a[3] | b[3])


def _fields(rows: pa.ListArray, *names: str) -> list[np.ndarray]:
    flat = rows.flatten()
    out = []
    for name in names:
        values = flat.field(name).to_numpy(zero_copy_only=False)
        out.append(values.view(np.uint64) if name in ("code", "unsure") else values)
    return out


def _candidates(edges: list[int], reach: int):
    """Buckets compared by code: the members that own a pair within the radius."""
    masks = _masks(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("rows"))
            sizes = np.diff(rows.offsets.to_numpy()).astype(np.int64)
            start = np.cumsum(sizes) - sizes
            of = _fields(rows, "node", "code", "unsure", "home")
            table = batch.column(batch.schema.get_field_index("t")).to_numpy()
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            stays = np.zeros(len(bucket), bool)
            # Row i is compared with those after it in its bucket.
            after = (start + sizes)[bucket] - np.arange(len(bucket)) - 1
            total, at = np.cumsum(after), 0
            while at < len(after):
                done = total[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(total, done + CROSS_ROWS, "right")))
                n = after[at:stop]
                i = np.repeat(np.arange(at, stop), n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                near = np.bitwise_count(of[1][i] ^ of[1][j]) <= reach
                i, j = i[near], j[near]
                own = _owned(table[bucket[i]], masks, [f[i] for f in of], [f[j] for f in of])
                stays[i[own]] = stays[j[own]] = True
                at = stop
            kept = np.flatnonzero(stays)
            outer, flat = pa.array(bucket[kept]), rows.flatten().take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)).take(outer) for c in _BUCKET]
                + [flat.field(c) for c in ("node", "code", "unsure", "home")], names=[*_BUCKET, "node", "code", "unsure", "home"])

    return run


def _rerank(edges: list[int], reach: int, similarity: float):
    """Tiles of vectors: (u, null, links) for every node with links and a forest of edges (u, v, null)."""
    masks = _masks(edges)

    def tile(t: int, of: list, side: np.ndarray, copies: np.ndarray, x: np.ndarray):
        """Owned linked pairs (positions) of one tile or pair of tiles."""
        home, other = of[3], side.any()
        left, right = (side == 0, side == 1) if other else (side == 0, side == 0)
        parts = [(np.flatnonzero(left & home), np.flatnonzero(right))]
        if other:
            parts.append((np.flatnonzero(left & ~home), np.flatnonzero(right & home)))
        for a, b in parts:
            step = max(1, CROSS_ROWS // max(len(b), 1))
            for at in range(0, len(a) if len(b) else 0, step):
                i, j = np.nonzero(x[a[at:at + step]] @ x[b].T >= similarity)
                i, j = a[at + i], b[j]
                once = (i < j) | ~home[j] if not other else np.ones(len(i), bool)
                once &= (i != j) & (np.bitwise_count(of[1][i] ^ of[1][j]) <= reach)
                i, j = i[once], j[once]
                own = _owned(np.full(len(i), t), masks, [f[i] for f in of], [f[j] for f in of])
                yield i[own], j[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = batch.column(batch.schema.get_field_index("t")).to_pylist()
            rows = batch.column(batch.schema.get_field_index("rows"))
            for k, t in enumerate(tables):
                one = rows.slice(k, 1)
                of = _fields(one, "node", "code", "unsure", "home")
                side, copies = _fields(one, "side", "copies")
                x = unit_matrix(one.flatten().field("vector"))
                links, us, vs = np.zeros(len(x), np.int64), [], []
                for i, j in tile(t, of, side, copies, x):
                    links += np.bincount(i, copies[j], len(x)).astype(np.int64)
                    links += np.bincount(j, copies[i], len(x)).astype(np.int64)
                    if len(i):
                        u, v = _forest(of[0][i], of[0][j])
                        us.append(u)
                        vs.append(v)
                if not us:
                    continue
                has = np.flatnonzero(links)
                u, v = _forest(np.concatenate(us), np.concatenate(vs))
                none = pa.nulls(len(has), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(of[0][has]), none, pa.array(links[has])], names=["u", "v", "links"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names=["u", "v", "links"])

    return run


def _usable(label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _told(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, vector, usable, h1, h2); the two hashes name label and vector."""
    kind = vectors.schema[vector].dataType.elementType.typeName()
    body = F.col(vector) if kind in ("float", "double") else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), body.alias("vector"))
    return rows.withColumn("usable", _usable(F.col("label"), F.col("vector"))).withColumns(
        {h: F.when(F.col("usable"), F.xxhash64(F.lit(k), "label", "vector")) for k, h in enumerate(("h1", "h2"))})


def _probes(coded: DataFrame, edges: list[int]) -> DataFrame:
    """One row for every key under which a node looks in a table."""
    masks = _masks(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, unsure = (batch.column(k).to_numpy().view(np.uint64) for k in (3, 4))
            for t, mask in enumerate(masks):
                keys = probe_keys(code, unsure, mask)
                of = pa.array(np.repeat(np.arange(len(code)), keys.shape[1]))
                home = np.zeros(keys.shape, bool)
                home[:, 0] = True
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(of), batch.column(2).take(of), pa.array(np.full(len(of), t, np.int32)),
                     pa.array(keys.ravel().view(np.int64)), *[batch.column(k).take(of) for k in (0, 3, 4)],
                     pa.array(home.ravel())], names=[*_BUCKET, "node", "code", "unsure", "home"])

    kind = coded.schema["label"].dataType.simpleString()
    return coded.select("node", "label", "dim", "code", "unsure").mapInArrow(
        run, f"label {kind}, dim int, t int, key long, node long, code long, unsure long, home boolean")


def _coded(nodes: DataFrame, mean: np.ndarray, axes: np.ndarray, edges: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, unsure = encode((unit_matrix(batch.column(3), len(mean)) - mean) @ axes, edges)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(code.view(np.int64)), pa.array(unsure.view(np.int64))],
                    names=["node", "label", "dim", "code", "unsure"])

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "dim", "vector").mapInArrow(
        run, f"node long, label {kind}, dim int, code long, unsure long")


def links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v, links) over stored nodes (node, label, dim, vector, h1, copies).

    Rows without ``v`` are shares of a node's number of links, to be summed; the others are
    edges that join nodes exactly as the links do.
    """
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(
        F.sum("n").alias("n"), F.max("n").alias("largest"))
    found = sizes.agg(F.max_by("dim", F.struct("n", -F.col("dim"))).alias("dim"), F.max("largest").alias("largest")).first()
    d, largest = found["dim"] or 1, found["largest"] or 0
    bits = min(CODE_BITS, d)
    sample = nodes.filter(F.col("dim") == d).orderBy("h1", "node").limit(max(1, min(SAMPLE_ROWS, (1 << 25) // (8 * d))))
    column = sample.select("vector").toArrow().column(0).combine_chunks()
    mean, axes = fit_rotation(unit_matrix(column, d), bits)
    edges, reach = table_edges(bits, largest), radius(bits)
    tile_rows = max(64, min(2048, TILE_BYTES // (8 * d)))

    coded = stored(_coded(nodes, mean, axes, edges), "codes")
    probes = _probes(coded, edges)
    hot = stored(probes.groupBy(*_BUCKET).agg(F.count("*").alias("n")).filter(F.col("n") > tile_rows).select(
        *_BUCKET, F.ceil(F.col("n") / tile_rows).cast("int").alias("parts")), "hot")
    row = F.struct("node", "code", "unsure", "home")
    near = probes.join(hot, _BUCKET, "left_anti").groupBy(*_BUCKET).agg(F.collect_list(row).alias("rows")).filter(
        F.size("rows") > 1)
    kind = nodes.schema["label"].dataType.simpleString()
    members = near.mapInArrow(
        _candidates(edges, reach),
        f"label {kind}, dim int, t int, key long, node long, code long, unsure long, home boolean").withColumn("parts", F.lit(1))
    dense = probes.join(hot, _BUCKET)
    both = members.unionByName(dense).join(nodes.select("node", "vector", "copies"), "node")
    part, other = F.col("part"), F.col("other")
    tiled = both.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *_BUCKET, F.least(part, other).alias("lo"), F.greatest(part, other).alias("hi"),
        F.struct("node", "code", "unsure", "home", (part > other).cast("int").alias("side"), "copies", "vector").alias("row"))
    tiles = tiled.groupBy(*_BUCKET, "lo", "hi").agg(F.collect_list("row").alias("rows")).filter(F.size("rows") > 1)
    out = stored(tiles.select("t", "rows").mapInArrow(
        _rerank(edges, reach, similarity), "u long, v long, links long"), "links")
    for done in (coded, hot):
        drop_stored(done)
    return out


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    rows = _told(vectors, key, vector, label)
    nodes = stored(rows.filter("usable").groupBy("label", "vector", "h1", "h2").agg(
        F.min("key").alias("first_id"), F.count("*").alias("copies")).withColumn(
        "node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "nodes")
    found = links(nodes, similarity)
    counts = found.filter("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("v IS NOT NULL").select("u", "v"))
    placed = nodes.select("node", "h1", "h2", "first_id", "copies").join(counts, "node", "left").join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = placed.join(named, "root").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.filter("usable").select("key", "h1", "h2").join(told, ["h1", "h2"]).select("key", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", similarity: float = SIMILARITY,
) -> DataFrame:
    """Rows of ``vectors`` whose id names their component; rows with a null id only if nothing in it has one."""
    kept = near_duplicates(vectors, key, vector, label, similarity).filter("kept").select(F.col(key).alias("kept_id")).distinct()
    rows = vectors.alias("rows_in")
    return rows.join(kept.alias("kept_in"), F.col(f"rows_in.{key}").eqNullSafe(F.col("kept_in.kept_id")), "left_semi")
