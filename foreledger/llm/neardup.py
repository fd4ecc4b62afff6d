"""Near-duplicate stage: texts whose five-word shingles agree to 0.8 or more are linked.

Texts with one shingle set are one node.  A node's MinHash signature is cut into bands;
nodes that agree on a whole band share a bucket.  At similarity 0.8 a pair meets in some
bucket with probability ``1 - (1 - 0.8 ** 5) ** 20``, 0.9996, above it more often.  A pair
that meets is linked only if the Jaccard similarity of the shingle sets, compared as
64-bit hashes in full, reaches the threshold, so no text is linked by chance.

Every set also has a parity sketch: bit k tells whether an odd number of its shingles
falls on k.  Two sets differ in at least as many shingles as their sketches do in bits, so
sketches bound a similarity from above, and no pair that could reach the threshold is
dropped by them.

Every bucket has a lead of its own, drawn by hash.  A node is compared in full with those
of its leads that its sketch allows, so a group of near copies costs a band's number of
comparisons a member at most.  In the buckets that then hold more than one component, pairs
of different components are compared by sketch, tile by tile inside a task; only pairs that
could be alike come out and are compared in full.

With a ``radius`` the links of ``simhash`` come first: texts whose fingerprints differ in
that many bits or fewer are linked as its exact search finds them, and the links above are
added to theirs before components are made.

Defined cases: words are those of ``simhash``; a text shorter than a shingle is one
shingle; null and wordless texts have the empty set and are one node; a null id keeps its
row and never names a component with another id in it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreledger.llm.components import components
from foreledger.llm.simhash import fingerprint_of, first_of_repeats, linked_pairs
from foreledger.llm.words import byte_words
from foreledger.sources.stored import drop_stored, stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 20, 5
SEED = 42
SKETCH_BITS = 512
TILE_ROWS = 1024
_BLOCK = 1 << 12
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    parts, carry = [], []
    for words in byte_words(text, lower=True):
        words = carry + words
        if len(words) >= SHINGLE_WORDS:
            parts.append(_hashes(words, SHINGLE_WORDS))
            carry = words[len(words) - SHINGLE_WORDS + 1:]
        else:
            carry = words
    if not parts and carry:
        parts.append(_hashes(carry, len(carry)))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, digest = (ends - lengths).tolist(), xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())), np.uint64, len(words) - width + 1)


def node_of(hashes: np.ndarray) -> int:
    """Digest of a shingle set as a signed long."""
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64).astype(np.int64)[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed long for every band of the MinHash signature; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), _BLOCK):
        mixed = hashes[a:a + _BLOCK] ^ (hashes[a:a + _BLOCK] >> np.uint64(31))
        least = np.minimum(least, (_FACTORS[:, None] * mixed).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(rows)]
    return np.array(keys, np.uint64).astype(np.int64).tolist()


def parity_sketch(hashes: np.ndarray) -> list[int]:
    """Parities of the numbers of hashes on each of SKETCH_BITS places, as signed longs."""
    places = (hashes >> np.uint64(11)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tx, node, size, bands, sketch, fp) of every row; ``tx`` names the text, ``fp`` is its SimHash."""
    rows = docs.select(F.col(key), F.xxhash64(F.col(text)).alias("tx"), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            sets = [shingle_set(t) for t in texts]
            prints = np.array([fingerprint_of(t) for t in texts], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([node_of(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                 pa.array([parity_sketch(s) for s in sets], pa.list_(pa.int64())), pa.array(prints, pa.int64())],
                names=[key, "tx", "node", "size", "bands", "sketch", "fp"])

    return rows.mapInArrow(
        run, f"`{key}` {rows.schema[0].dataType.simpleString()}, tx long, node long, size long, "
        "bands array<long>, sketch array<long>, fp long")


def _sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the texts whose ``tx`` is in ``wanted``."""
    named = docs.select(F.xxhash64(F.col(text)).alias("tx"), F.col(text).alias("text"))
    texts = named.join(wanted, "tx", "left_semi").groupBy("tx").agg(F.min("text").alias("text")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in sets], pa.int64()),
                 pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose shingle sets reach the similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set")) for c in "uv")
    shared = F.size(F.array_intersect("u_set", "v_set"))
    whole = F.size("u_set") + F.size("v_set") - shared
    return pairs.join(left, "u").join(right, "v").filter(shared / whole >= similarity).select("u", "v")


def _bounded(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v, bound): the pairs whose sketches allow the similarity, and the most it can be."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch"))
                   for c in "uv")
    apart = F.aggregate(F.zip_with("u_sketch", "v_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    whole = F.col("u_size") + F.col("v_size")
    shared = F.least(F.col("u_size"), F.col("v_size"), F.floor((whole - apart) / 2))
    return pairs.join(left, "u").join(right, "v").select(
        "u", "v", (shared / (whole - shared)).alias("bound")).filter(F.col("bound") >= similarity)


def _promising(similarity: float):
    """Tiles of a bucket: pairs of different components whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = batch.column(0)
            ends = tiles.offsets.to_numpy()
            flat = tiles.flatten()
            side, node, root, size = (flat.field(c).to_numpy() for c in ("side", "node", "root", "size"))
            sketch = flat.field("sketch").flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
            us, vs = [], []
            for start, end in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist()):
                here = np.arange(start, end)
                right = here[side[start:end] == 1]
                left = here[side[start:end] == 0]
                right = right if len(right) else left
                step = max(1, (1 << 20) // len(right))
                for at in range(0, len(left), step):
                    a = left[at:at + step, None]
                    apart = sum(np.bitwise_count(sketch[a, k] ^ sketch[right, k]).astype(np.int64) for k in range(sketch.shape[1]))
                    whole = size[a] + size[right]
                    shared = np.minimum(np.minimum(size[a], size[right]), (whole - apart) // 2)
                    i, j = np.nonzero((root[a] < root[right]) & (shared >= similarity * (whole - shared)))
                    us.append(node[left[at + i]])
                    vs.append(node[right[j]])
                    if left is not right:
                        i, j = np.nonzero((root[a] > root[right]) & (shared >= similarity * (whole - shared)))
                        us.append(node[left[at + i]])
                        vs.append(node[right[j]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _across(rest: DataFrame, similarity: float, tile_rows: int) -> DataFrame:
    """(u, v): pairs within a bucket, of different roots, that could be alike."""
    sizes = rest.groupBy("bucket").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    part, other = F.col("part"), F.col("other")
    tiled = rest.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket", F.least(part, other).alias("lo"), F.greatest(part, other).alias("hi"),
        F.struct((part > other).cast("int").alias("side"), "node", "root", "size", "sketch").alias("row"))
    tiles = tiled.groupBy("bucket", "lo", "hi").agg(F.collect_list("row").alias("rows")).filter(F.size("rows") > 1)
    return tiles.select("rows").mapInArrow(_promising(similarity), "u long, v long").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def fingerprint_links(marked: DataFrame, radius: int) -> DataFrame:
    """(u, v): edges that connect the nodes whose fingerprints chains of SimHash links connect."""
    held = marked.select("fp", "node").distinct()
    heads = stored(held.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    near = linked_pairs(heads.select("fp"), radius)
    of = {c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in "uv"}
    across = near.join(of["u"], "u").join(of["v"], "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    return across.unionByName(held.join(heads, "fp").filter("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")))


def linked(
    docs: DataFrame, marked: DataFrame, text: str, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS,
    radius: int | None = None,
) -> DataFrame:
    """(node, root) of every node with a link that is not the root, its component's least node."""
    nodes = stored(marked.groupBy("node").agg(
        F.min("tx").alias("tx"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("bucket"))
    leads = keyed.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "bucket")).alias("lead")).filter("n > 1")
    members = stored(keyed.join(leads.select("bucket", "lead"), "bucket"), "members")
    sets = stored(_sets(docs, text, nodes.join(members.select("node").distinct(), "node", "left_semi").select("tx")), "sets")
    stars = _bounded(members.filter("node <> lead").select(
        F.col("node").alias("u"), F.col("lead").alias("v")).distinct(), nodes, similarity)
    links = _alike(stars.select("u", "v"), sets, similarity)
    if radius is not None:
        links = links.unionByName(fingerprint_links(marked, radius))
    roots = stored(components(links), "roots")
    placed = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
    rest = placed.join(mixed, "bucket", "left_semi").join(nodes.select("node", "size", "sketch"), "node")
    # Links between components join their roots; the least of the roots is the least node.
    of = {c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "uv"}
    between = _alike(_across(rest, similarity, tile_rows), sets, similarity).join(of["u"], "u", "left").join(
        of["v"], "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    moved = components(between)
    further = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left")
    for done in (nodes, members, sets):
        drop_stored(done)
    return further.select("node", F.coalesce("least", "root").alias("root")).unionByName(moved)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int | None = None,
) -> DataFrame:
    """(key, tx, root, component_id) of every row; the least key reachable over links."""
    marked = stored(_marked(docs, key, text), "marked")
    roots = linked(docs, marked, text, similarity, radius=radius)
    first = marked.groupBy("node").agg(F.min(key).alias("first_id"))
    placed = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.select(key, "tx", "node").join(placed.join(named, "root").select(
        "node", "root", "component_id"), "node").select(key, "tx", "root", "component_id")


def deduplicated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int | None = None,
) -> DataFrame:
    """One row of every group: of the id that names it, or of its null ids if it has no other."""
    found = near_duplicates(docs, key, text, similarity, radius).filter(F.col(key).eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root", key).agg(F.min("tx").alias("__tx")).select(
        F.col(key).alias("__kept"), "__tx").distinct()
    same = F.col(key).eqNullSafe(F.col("__kept")) & (F.xxhash64(F.col(text)) == F.col("__tx"))
    return first_of_repeats(docs.join(kept, same, "left_semi"), key, text)
