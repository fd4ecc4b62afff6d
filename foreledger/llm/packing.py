"""Best-fit packing into sequences of several permitted lengths.

Pieces are taken longest first.  A piece goes to the open bin with the least room that
still holds it, whatever that bin's size.  Where none does, the size opened is the one
of least cost per token it is expected to hold: for each permitted size the pieces still
to come are tried against the room left.  In the end every bin is cut down to the
smallest permitted length that holds its contents.

Texts longer than the largest length are cut in pieces of that length and a rest.  Only
ids and lengths are shuffled: rows are dealt by hash to shards of bounded size, each
packed by itself, so work and memory per task do not grow with the corpus.  A shard has
thousands of pieces; only its last bins can be less full than those of one global run.

Defined cases: a null or empty text has no token and one piece of length zero; a null id
is allowed; rows that repeat an id and a length are counted first and told apart by
``copy``, so they are dealt to many shards; ties go by id, copy and piece; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreledger.sources.stored import stored

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_PIECES = 2048
# Cost of one sequence of length c: OVERHEAD + c + c * c / ATTENTION, in token units.
OVERHEAD = 32.0
ATTENTION = 65536.0


def sequence_cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / ATTENTION


class _Coming:
    """Lengths still to be placed, for the trial fill of a bin."""

    def __init__(self, lengths: Sequence[int]) -> None:
        self.left = Counter(lengths)
        self.sorted = sorted(n for n in self.left if n)

    def take(self, length: int) -> None:
        self.left[length] -= 1
        if not self.left[length] and length:
            del self.sorted[bisect_left(self.sorted, length)]

    def fill(self, room: int) -> int:
        """Tokens that the longest pieces which fit, one after the other, put into a room."""
        used, at = 0, len(self.sorted)
        while room > 0:
            at = bisect_right(self.sorted, room, 0, at) - 1
            if at < 0:
                break
            n = self.sorted[at]
            k = min(self.left[n], room // n)
            used, room = used + k * n, room - k * n
        return used


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of every piece and the final length of every bin.

    ``lengths`` fall; none is longer than the largest capacity.
    """
    sizes = sorted(capacities)
    coming = _Coming(lengths)
    rooms: list[int] = []
    bins_with: dict[int, list[int]] = {}
    filled: list[int] = []
    where, offsets = [], []

    def offer(b: int, room: int) -> None:
        held = bins_with.setdefault(room, [])
        if not held:
            insort(rooms, room)
        held.append(b)

    for n in lengths:
        coming.take(n)
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = bins_with[room].pop()
            if not bins_with[room]:
                del rooms[at]
        else:
            fitting = sizes[bisect_left(sizes, n):]
            room = min(fitting, key=lambda c: (sequence_cost(c) / max(n + coming.fill(c - n), 1), c))
            b = len(filled)
            filled.append(0)
        where.append(b)
        offsets.append(filled[b])
        filled[b] += n
        offer(b, room - n)
    return where, offsets, [sizes[bisect_left(sizes, used)] for used in filled]


def packed(
    lengths: DataFrame, key: str = "doc_id", length: str = "n_tokens", capacities: Sequence[int] = CAPACITIES,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: (key, copy, piece, start, length, bin_id, position, capacity).

    ``start`` is the piece's first token in its text, ``position`` its place in the bin.
    """
    longest = max(capacities)
    alike = stored(lengths.groupBy(F.col(key).alias("id"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n"))
                   .agg(F.count("*").alias("copies")), "lengths")
    pieces_of = F.greatest(F.ceil(F.col("n") / longest), F.lit(1))
    total = alike.agg(F.sum(F.col("copies") * pieces_of)).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    each = alike.select("id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        "id", "n", "copy", F.explode(F.sequence(F.lit(0).cast("long"), pieces_of - 1)).alias("piece"))
    start = F.col("piece") * longest
    dealt = each.select(
        F.pmod(F.xxhash64("id", "n", "copy", "piece"), F.lit(shards)).alias("shard"), "id", "copy", "piece",
        start.alias("start"), F.least(F.col("n") - start, F.lit(longest)).alias("length"))
    kind = dealt.schema["id"].dataType.simpleString()

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        rows = shard.sort_values(["length", "id", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        where, offsets, final = pack(rows["length"].tolist(), capacities)
        bins = np.array(where, np.int64)
        return pd.DataFrame({
            "id": rows["id"], "copy": rows["copy"], "piece": rows["piece"], "start": rows["start"],
            "length": rows["length"], "bin_id": (rows["shard"].to_numpy(np.int64) << 32) + bins,
            "position": np.array(offsets, np.int64), "capacity": np.array(final, np.int64)[bins]})

    out = dealt.groupBy("shard").applyInPandas(
        run, f"id {kind}, copy long, piece long, start long, length long, bin_id long, position long, capacity long")
    return out.withColumnRenamed("id", key)


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
    capacities: Sequence[int] = CAPACITIES,
) -> DataFrame:
    """Pack whole documents by their number of tokens."""
    from foreledger.llm.tokens import token_counts

    return packed(token_counts(docs, key, text, vocabulary), key, "n_tokens", capacities)
