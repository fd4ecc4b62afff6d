"""Ordered scans and order statistics that survive a hot group.

A plain window puts a whole group in one task.  Here groups are cut into chunks
by expressions that rise with the row order.  Each chunk is scanned on its own,
a one-row summary per chunk carries the earlier totals forward, and the two meet
in a join on (group, chunk), the partitioning the rows have already.  Rows are
shuffled once.  A null group is a group like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreledger.functions.scalar import bands_of, key_text
from foreledger.sources.stored import stored

_BEFORE = (Window.unboundedPreceding, -1)


def time_chunk(ts: str, seconds: int = 86_400) -> Column:
    """Chunk number of a timestamp column: monotone in time, about a day each."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000))


def cut(df: DataFrame, chunk: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """Append one column per chunk expression; the frame and the names."""
    names = [f"__chunk{i}" for i in range(len(chunk))]
    return df.select(*df.columns, *[c.alias(n) for n, c in zip(names, chunk)]), names


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which a null equals a null; the keys stay once."""
    other = right.select(*[F.col(c).alias(f"__on_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys]
    out = left.crossJoin(other) if not keys else left.join(other, same, how)
    return out.drop(*[f"__on_{k}" for k in keys])


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    chunk: Sequence[Column] = (),
) -> DataFrame:
    """Append running values over the rows strictly before each row.

    ``sums``  name -> expression: sum of the expression over earlier rows, 0 if none.
    ``lasts`` name -> expression: latest earlier non-null value, null if none.
    ``chunk`` monotone expressions of ``order`` to cut groups by; empty when a
    group is bounded by construction (for example by its document).
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    src, names = cut(df, chunk)
    keys = [*group, *names]
    values = {f"__s_{n}": e for n, e in sums.items()} | {f"__l_{n}": e for n, e in lasts.items()}
    # Chunks are dealt out before the values are made, so the shuffle moves no value twice.
    placed = (src.repartition(*keys) if names else src).withColumns(values)
    src = src.withColumns(values)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_BEFORE)
    local = placed.withColumns(
        {f"__ps_{n}": F.sum(f"__s_{n}").over(w) for n in sums}
        | {f"__pl_{n}": F.last(f"__l_{n}", ignorenulls=True).over(w) for n in lasts}
    )
    if not names:
        return local.select(
            *df.columns,
            *[F.coalesce(f"__ps_{n}", F.lit(0)).alias(n) for n in sums],
            *[F.col(f"__pl_{n}").alias(n) for n in lasts],
        )
    at = F.struct(*order)
    summary = src.groupBy(*keys).agg(
        *[F.sum(f"__s_{n}").alias(f"__ts_{n}") for n in sums],
        *[
            F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), at)).alias(f"__tl_{n}")
            for n in lasts
        ],
    )
    cw = Window.partitionBy(*group).orderBy(*names).rowsBetween(*_BEFORE)
    # The first chunk of a group has nothing to carry in; the join leaves its rows as they are.
    carry = summary.select(
        *keys, F.count(F.lit(1)).over(cw).alias("__earlier"),
        *[F.sum(f"__ts_{n}").over(cw).alias(f"__cs_{n}") for n in sums],
        *[F.last(f"__tl_{n}", ignorenulls=True).over(cw).alias(f"__cl_{n}") for n in lasts],
    ).filter("__earlier > 0").drop("__earlier")
    zero = F.lit(0)
    return join_on(local, carry, keys, "left").select(
        *df.columns,
        *[
            (F.coalesce(f"__ps_{n}", zero) + F.coalesce(f"__cs_{n}", zero)).alias(n)
            for n in sums
        ],
        *[F.coalesce(f"__pl_{n}", f"__cl_{n}").alias(n) for n in lasts],
    )


# Rows of a group that one task takes whole, rows that one task sorts, and cells in which large groups are looked for.
WHOLE_ROWS, TASK_ROWS, CELLS = 200_000, 500_000, 65_536


def by_size(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows dealt out by group, rows of groups that may be too large for that; None without such).

    Rows are counted by a hash of their group first, so a group with more than WHOLE_ROWS
    is never missed; one that shares its cell counts as large too.
    """
    cell = F.pmod(F.xxhash64(*group), F.lit(CELLS))
    seen = df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    got = seen.agg(F.sum("n").alias("n"), F.collect_list(F.when(n > WHOLE_ROWS, F.col("cell"))).alias("large")).first()
    small = df.filter(~cell.isin(got["large"])) if got["large"] else df
    tasks = -(-(got["n"] or 0) // TASK_ROWS)
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = small.repartition(tasks, *group) if tasks > default else small.repartition(*group)
    return placed, df.filter(cell.isin(got["large"])) if got["large"] else None


def dense_index(
    df: DataFrame, key_cols: Sequence[str], out: str, salt: str = "", hex_digits: int = 3
) -> DataFrame:
    """Number the rows 0..n-1 in a fixed, hash-scattered order of a unique key.

    Rows are numbered inside 16**hex_digits md5 buckets; only bucket counts are
    accumulated in one place, so no task sees the whole frame.
    """
    digest = F.md5(F.concat(F.lit(salt), key_text(*[F.col(c) for c in key_cols])))
    src = df.withColumn("__h", digest).withColumn("__b", F.substring("__h", 1, hex_digits))
    starts = (
        src.groupBy("__b").count()
        .select("__b", F.coalesce(
            F.sum("count").over(Window.orderBy("__b").rowsBetween(*_BEFORE)), F.lit(0)
        ).alias("__start"))
    )
    if hex_digits <= 4:  # at most 65,536 rows
        starts = F.broadcast(starts)
    within = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *key_cols))
    return (
        src.withColumn("__rn", within).join(starts, "__b")
        .select(*df.columns, (F.col("__start") + F.col("__rn") - 1).alias(out))
    )


_BASE = 4096
_DIGITS = 2


def pin(df: DataFrame) -> DataFrame:
    """Fix an intermediate on the shared folder so later steps do not recompute it."""
    return stored(df, "pinned")


def _digit(x: Column) -> Column:
    return F.least(F.floor(x * _BASE), F.lit(_BASE - 1)).cast("int")


def _pick(ranks: DataFrame, hist: DataFrame, keys: Sequence[str], digit: str) -> DataFrame:
    """Find the histogram cell of each wanted rank and the rank left inside it."""
    w = Window.partitionBy(*keys).orderBy(digit)
    cum = hist.select(
        *keys, digit, F.col("n").alias("__n"),
        F.coalesce(F.sum("n").over(w.rowsBetween(*_BEFORE)), F.lit(0)).alias("__lo"),
    )
    hit = (F.col("rank") >= F.col("__lo")) & (F.col("rank") < F.col("__lo") + F.col("__n"))
    return (
        join_on(ranks.drop("__n"), cum, keys).filter(hit)
        .withColumn("rank", F.col("rank") - F.col("__lo")).drop("__lo")
    )


def _digits(df: DataFrame, value: str, n: int) -> DataFrame:
    """Base-4096 digits __d0.. of a value in [0, 1]; every step is exact."""
    x = F.col(value)
    for i in range(n):
        df = df.withColumn(f"__d{i}", _digit(x)).withColumn("__x", x * _BASE - F.col(f"__d{i}"))
        x = F.col("__x")
    return df.drop("__x")


def _edge_ranks(sizes: DataFrame, group: Sequence[str], bins: Column) -> DataFrame:
    """The two ranks around every interior edge h = (n-1)(k/B), with their weight."""
    ks = sizes.withColumn("bins", bins.cast("int")).filter("bins > 1").select(
        *group, F.explode(F.sequence(F.lit(1), F.col("bins") - 1)).alias("k"),
        (F.col("n") - 1).alias("m"), (F.lit(1.0) / F.col("bins")).alias("step"),
    ).withColumn("h", F.col("m") * (F.col("k") * F.col("step")))
    side = lambda r, i: F.struct(r.cast("long").alias("rank"), F.lit(i).alias("side"))
    return ks.select(
        *group, "k", (F.col("h") - F.floor("h")).alias("frac"),
        F.explode(F.array(side(F.floor("h"), 0), side(F.ceil("h"), 1))).alias("r"),
    ).select(*group, "k", "frac", "r.rank", "r.side")


def equal_mass_edges(
    df: DataFrame, group: Sequence[str], value: str, n_bins: int | Column = 20, weight: str | None = None
) -> DataFrame:
    """Interior equal-mass edges per group as a sorted array column ``edges``.

    Exact for values in [0, 1]: linear interpolation between order statistics,
    taken from the nearer end.  Rows are counted by the first base-4096 digit of
    the value, those in a cell with a wanted rank by the second, and those in a
    wanted cell of that by value.  Rows are never sorted and only counts are
    shuffled, so neither a hot group nor a pile of equal values matters.
    ``n_bins`` may be a Column over the group size ``n``.  A row stands for ``weight`` rows.
    """
    src = df.select(*group, F.col(value).alias("__v"), *([] if weight is None else [F.col(weight).alias("__n_rows")]))
    count = (F.count(F.lit(1)) if weight is None else F.sum("__n_rows")).alias("n")
    hist = pin(_digits(src, "__v", 1).groupBy(*group, "__d0").agg(count))
    sizes = hist.groupBy(*group).agg(F.sum("n").alias("n"))
    bins = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
    keys, cells = list(group), _edge_ranks(sizes, group, bins)
    for depth in range(1, _DIGITS + 1):
        cells = pin(_pick(cells, hist, keys, f"__d{depth - 1}"))
        keys.append(f"__d{depth - 1}")
        inside = join_on(_digits(src, "__v", depth), cells.select(*keys).distinct(), keys)
        if depth < _DIGITS:
            hist = pin(_digits(inside, "__v", depth + 1).groupBy(*keys, f"__d{depth}").agg(count))
    vals = _pick(cells, inside.groupBy(*keys, "__v").agg(count), keys, "__v")
    at = lambda i: F.max(F.when(F.col("side") == i, F.col("__v")))
    gap = F.col("hi") - F.col("lo")
    edge = F.when(F.col("frac") < 0.5, F.col("lo") + gap * F.col("frac")).otherwise(
        F.col("hi") - gap * (1 - F.col("frac")))
    edges = (
        vals.groupBy(*group, "k").agg(at(0).alias("lo"), at(1).alias("hi"),
                                      F.max("frac").alias("frac"))
        .withColumn("edge", edge)
        .groupBy(*group).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    )
    none = F.array().cast("array<double>")
    return pin(join_on(sizes, edges, group, "left").select(
        *group, "n", F.coalesce("edges", none).alias("edges")))


def attach_bins(
    df: DataFrame, edges: DataFrame, group: Sequence[str], value: str, out: str = "bin"
) -> DataFrame:
    """Join each group's edges and number the bin of every row.  Ties share a bin."""
    return (
        join_on(df, edges, group)
        .withColumn(out, bands_of(F.col(value), F.col("edges"))).drop("edges")
    )


def with_bins(
    df: DataFrame, group: Sequence[str], value: str, n_bins: int | Column = 20, out: str = "bin"
) -> DataFrame:
    """Attach the equal-mass bin of every row."""
    return attach_bins(df, equal_mass_edges(df, group, value, n_bins).drop("n"), group, value, out)

