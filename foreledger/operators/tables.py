"""Count tables: marginals, prefix-shrunk estimates, entity effects, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreledger.functions.scalar import EPS_BOARD, band_left, band_right, clip, shared_out, softmax
from foreledger.operators.scan import join_on


def _class_sums(y: str, k: int) -> list[Column]:
    return [F.sum(F.when(F.col(y) == i, 1).otherwise(0)).alias(f"__c{i}") for i in range(k)]


def _array(cols: Sequence[Column]) -> Column:
    return F.array(*[c.cast("double") for c in cols])


def laplace_marginal(train: DataFrame, y: str, k: int) -> DataFrame:
    """One row (n, probs): class shares with one pseudo-count per class."""
    n = F.count(F.lit(1)).alias("n")
    agg = train.agg(n, *_class_sums(y, k))
    return agg.select(
        "n", _array([(F.col(f"__c{i}") + 1.0) / (F.col("n") + k) for i in range(k)]).alias("probs")
    )


def laplace_marginal_long(train: DataFrame, y: str, k: int) -> DataFrame:
    """The marginal as rows (y, p) over the whole alphabet."""
    m = laplace_marginal(train, y, k)
    return m.select(F.posexplode("probs").alias(y, "p"))


def group_base_rate(train: DataFrame, group: Sequence[str], y: str,
                    order: Sequence[str]) -> DataFrame:
    """Mean label with one vote per group: the group's first label in row order."""
    per = train.groupBy(*group).agg(F.min_by(y, F.struct(*order)).alias("__y"))
    return per.agg(F.avg("__y").alias("base_rate"), F.count(F.lit(1)).alias("n_groups"))


def class_table(train: DataFrame, keys: Sequence[str], y: str, k: int, tau: float,
                prior: DataFrame) -> DataFrame:
    """One-level shrunken class probabilities ``p`` per key, toward a one-row prior."""
    prior_probs = prior.select("probs").scalar()
    agg = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *_class_sums(y, k))
    counts = _array([F.col(f"__c{i}") for i in range(k)])
    est = F.zip_with(counts, F.col("__prior"),
                     lambda c, q: (c + F.lit(float(tau)) * q) / (F.col("__n") + F.lit(float(tau))))
    return agg.withColumn("__prior", prior_probs).select(*keys, est.alias("p"))


# ---- prefix-shrunk tables -------------------------------------------------

def rollup_totals(train: DataFrame, axes: Sequence[str], targets: Mapping[str, Column]) -> DataFrame:
    """Counts and target sums for every prefix of ``axes`` in one pass.

    ``depth`` is the prefix length; deeper axes are null.  Axes must not be null.
    """
    gid = F.grouping_id()
    depth = F.lit(len(axes)) - F.bit_count(gid)
    return train.rollup(*axes).agg(
        depth.cast("int").alias("depth"), F.count(F.lit(1)).alias("n"),
        *[F.sum(e).cast("double").alias(name) for name, e in targets.items()],
    )


def shrunk_levels(totals: DataFrame, axes: Sequence[str], targets: Sequence[str],
                  tau: float | Column) -> list[DataFrame]:
    """Estimates per depth: (sum + tau * parent) / (n + tau), root = plain mean.

    Cells meet their parent in an ordinary join on the parent's axes: an axis may
    have any number of values.
    """
    tau_c = F.lit(float(tau)) if not isinstance(tau, Column) else tau
    root = totals.filter("depth = 0").select(
        *[(F.col(t) / F.col("n")).alias(f"e_{t}") for t in targets]
    )
    levels = [root]
    for d in range(1, len(axes) + 1):
        keys = list(axes[:d])
        cur = totals.filter(F.col("depth") == d).select(*keys, "n", *targets)
        par = levels[-1].select(*keys[:-1], *[F.col(f"e_{t}").alias(f"__p_{t}") for t in targets])
        if d == 1:
            joined = cur.withColumns({f"__p_{t}": par.select(f"__p_{t}").scalar() for t in targets})
        else:
            joined = cur.join(par, keys[:-1])
        levels.append(joined.select(*keys, "n", *[
            ((F.col(t) + tau_c * F.col(f"__p_{t}")) / (F.col("n") + tau_c)).alias(f"e_{t}")
            for t in targets
        ]))
    return levels


def shrunk_table(train: DataFrame, axes: Sequence[str], targets: Mapping[str, Column],
                 tau: float) -> DataFrame:
    """All depths in long form: axes (null beyond depth), depth, n, e_<target>."""
    totals = rollup_totals(train, axes, targets)
    levels = shrunk_levels(totals, axes, list(targets), tau)
    n0 = totals.filter("depth = 0").select("n").scalar()
    out = None
    for d, lvl in enumerate(levels):
        cols = [F.col(a) if i < d else F.lit(None).cast(train.schema[a].dataType).alias(a)
                for i, a in enumerate(axes)]
        n = F.col("n") if d else n0.alias("n")
        part = lvl.select(*cols, F.lit(d).alias("depth"), n,
                          *[F.col(f"e_{t}") for t in targets])
        out = part if out is None else out.unionByName(part)
    return out


def prefix_lookup(df: DataFrame, levels: Sequence[DataFrame], axes: Sequence[str],
                  targets: Sequence[str]) -> DataFrame:
    """Estimate of the deepest known prefix of each row's axes, plus that depth.

    The distinct leaves of the rows meet the cells of all depths in one join on
    (depth, prefix) and keep the deepest hit; rows then meet their leaf.  No side
    is broadcast by force, and the rows are moved once at most.  A null axis is in
    no cell, so such a row stops at the prefix before it.
    """
    kinds = {a: levels[-1].schema[a].dataType for a in axes}

    def prefix(depth: int) -> Column:
        return F.struct(F.lit(depth).alias("d"), *[
            (F.col(a) if i < depth else F.lit(None)).cast(kinds[a]).alias(f"a{i}") for i, a in enumerate(axes)])

    found = F.struct(*[F.col(f"e_{t}") for t in targets])
    cells = reduce(DataFrame.unionByName, [
        level.select(prefix(d).alias("__key"), found.alias("__e")) for d, level in enumerate(levels)])
    leaves = df.select(*axes).distinct().select(
        *axes, F.explode(F.array(*[prefix(d) for d in range(len(axes) + 1)])).alias("__key"))
    best = leaves.join(cells, "__key").groupBy(*axes).agg(
        F.max_by(F.struct("__e", "__key.d"), F.col("__key.d")).alias("__best"))
    return join_on(df, best, axes, "left").select(
        *df.columns, *[F.col(f"__best.__e.e_{t}").alias(f"e_{t}") for t in targets],
        F.col("__best.d").alias("found_depth"))


def lattice(spark, sizes: Mapping[str, int]) -> DataFrame:
    """Every cell of a small integer lattice, from nested sequences."""
    out = spark.range(1)
    for name, size in sizes.items():
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return out.drop("id")


def lattice_counts(df: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """Leaf counts over the whole lattice, zero for cells without rows."""
    axes = list(sizes)
    seen = df.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))
    return lattice(df.sparkSession, sizes).join(F.broadcast(seen), axes, "left").fillna(0, ["n"])


# Band edges of the bucket table and the shrinkage grid.
PHASE_EDGES = {"t20": (36, 72, 96), "odi": (60, 180, 240)}
WICKET_EDGES = (2, 4, 6)
RATE_EDGES = (4.0, 6.0, 8.0, 10.0, 12.0)
TAU_GRID = (50.0, 200.0, 800.0)
TABLE_AXES = ("innings", "phase", "wkts", "rate")
# The columns that the axes are made of.
AXIS_SOURCES = ("is_chase", "legal_balls", "wickets", "rrr", "crr")
LATTICE = {"innings": 2, "phase": 4, "wkts": 4, "rate": 6}


def bucket_axes(df: DataFrame, fmt: str) -> DataFrame:
    """Append the four table axes of assembled rows; chases use the required rate."""
    chase = F.col("is_chase") >= 1.0
    return df.withColumns({
        "innings": chase.cast("int"),
        "phase": band_right(F.col("legal_balls"), PHASE_EDGES[fmt]),
        "wkts": band_right(F.col("wickets"), WICKET_EDGES),
        "rate": band_left(F.when(chase, F.col("rrr")).otherwise(F.col("crr")), RATE_EDGES),
    })


# ---- entity effects -------------------------------------------------------

def entity_counts(train: DataFrame, entity: str, y: str, k: int) -> DataFrame:
    """Per entity: n and the class-count vector.  Null entities are left out."""
    return (
        train.filter(F.col(entity).isNotNull()).groupBy(entity)
        .agg(F.count(F.lit(1)).alias("n"), *_class_sums(y, k))
        .select(entity, "n", _array([F.col(f"__c{i}") for i in range(k)]).alias("counts"))
    )


def offset_of(counts: Column, n: Column, pbar: Column, lam: Column | float) -> Column:
    """ln((c + lam*pbar)/(n + lam)) - ln(pbar), element-wise."""
    lam = F.lit(float(lam)) if not isinstance(lam, Column) else lam
    return F.zip_with(counts, pbar, lambda c, q: F.log((c + lam * q) / (n + lam)) - F.log(q))


def entity_offsets(train: DataFrame, entity: str, y: str, k: int, lam: float,
                   marginal: DataFrame | None = None) -> DataFrame:
    """Shrunken log-odds offsets per entity: (entity, n, offset[K]).

    The marginal counts every train row, null entities too.
    """
    if lam <= 0:
        raise ValueError(f"a prior needs a strength above zero, not {lam}")
    m = laplace_marginal(train, y, k) if marginal is None else marginal
    pbar = m.select("probs").scalar()
    return entity_counts(train, entity, y, k).withColumn("__q", pbar).select(
        entity, "n", offset_of(F.col("counts"), F.col("n"), F.col("__q"), lam).alias("offset")
    )


def attach_offsets(df: DataFrame, offsets: DataFrame, entity: str, k: int, out: str) -> DataFrame:
    """Look up an entity's vector; zeros when unseen or null.

    The effects grow with the data, so no broadcast is forced.
    """
    side = offsets.select(F.col(entity).alias("__e"), F.col("offset").alias("__o"))
    zeros = F.array(*[F.lit(0.0)] * k)
    return (
        df.join(side, F.col(entity) == F.col("__e"), "left")
        .withColumn(out, F.coalesce("__o", zeros)).drop("__e", "__o")
    )


def attach_seen(df: DataFrame, train: DataFrame, entity: str, out: str) -> DataFrame:
    """Was the row's entity observed in train?  Null counts as unseen."""
    known = train.select(F.col(entity).alias("__e")).filter("__e is not null").distinct()
    return (
        df.join(known, F.col(entity) == F.col("__e"), "left")
        .withColumn(out, F.col("__e").isNotNull()).drop("__e")
    )


def augment(base: Column, *offsets: Column, eps: float = EPS_BOARD) -> Column:
    """softmax(log base + offsets)."""
    z = F.transform(base, lambda x: F.log(F.greatest(x, F.lit(eps))))
    for o in offsets:
        z = F.zip_with(z, o, lambda a, b: a + b)
    return softmax(z)


def normalized(p: Column, floor: float = 1e-9) -> Column:
    """Floor every element, then divide by the total."""
    return shared_out(F.transform(p, lambda x: F.greatest(x, F.lit(floor))))


def expand_classes(probs: Column, seen: Sequence[int], k: int, floor: float = 1e-12) -> Column:
    """Place seen-class probabilities in the full alphabet, floor the rest, renormalise."""
    where = {c: i for i, c in enumerate(seen)}
    return shared_out(F.array(*[probs[where[c]] if c in where else F.lit(floor) for c in range(k)]))


def bounded(p: Column, eps: float = 1e-6) -> Column:
    return clip(p, eps, 1 - eps)

