"""Counts, shares, cross-tabs, dimensions and set checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys)


def class_shares(df: DataFrame, cls: str) -> DataFrame:
    """Count and share of total per class; the total runs over the class rows only."""
    c = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).scalar()
    return c.select(cls, "n", (F.col("n") / total).alias("share")).orderBy(F.desc("n"), cls)


def distinct_values(df: DataFrame, keys: Sequence[str], value: str,
                    more_than: int = 1) -> DataFrame:
    """Keys with more than a number of distinct values."""
    pairs = df.select(*keys, value).dropDuplicates()
    return pairs.groupBy(*keys).agg(F.count(value).alias("n_distinct")).filter(
        F.col("n_distinct") > more_than)


def distinct_groups(df: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Distinct groups per slice, in two partial aggregations."""
    return df.select(*by, group).dropDuplicates().groupBy(*by).agg(
        F.count(group).alias("n_groups"))


def entity_dimension(df: DataFrame, group: str, id_cols: Sequence[str], date_col: str,
                     names: DataFrame | None = None) -> DataFrame:
    """(entity, name, n_groups, first_seen, last_seen) over ids from several columns.

    ``names`` is (group, entity, name); a missing name falls back to the id.
    """
    ids = df.select(group, F.col(date_col).alias("__at"), F.explode(F.array_compact(F.array(
        *[F.col(c).cast("string") for c in id_cols]))).alias("entity"), F.lit(None).cast("string").alias("__name"), F.lit(True).alias("__id"))
    if names is not None:
        # Names come in as rows: ids and names are grouped once and need no join.
        ids = ids.unionByName(names.filter(F.col(group).isNotNull()).select(
            group, F.lit(None).cast(ids.schema["__at"].dataType).alias("__at"), F.col("entity").cast("string").alias("entity"),
            F.col("name").alias("__name"), F.lit(False).alias("__id")))
    seen = ids.groupBy(group, "entity").agg(
        F.min("__at").alias("__lo"), F.max("__at").alias("__hi"), F.min("__name").alias("__name"),
        F.max("__id").alias("__id")).filter("__id")
    return seen.groupBy("entity").agg(
        F.min(F.coalesce("__name", "entity")).alias("name"),
        F.count(F.lit(1)).alias("n_groups"), F.min("__lo").alias("first_seen"),
        F.max("__hi").alias("last_seen"))


def registry_names(docs: DataFrame, group: str, registry: str) -> DataFrame:
    """Invert a name -> id map column to (group, entity, name); the last name by order wins."""
    e = docs.select(group, F.explode(F.map_entries(registry)).alias("e"))
    return e.groupBy(group, F.col("e.value").alias("entity")).agg(F.max("e.key").alias("name"))


def reason_histogram(bad: DataFrame) -> DataFrame:
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason")


def coverage(all_docs: DataFrame, bad: DataFrame, out_of_scope: str = "E_FORMAT_OOS") -> DataFrame:
    """One row of disposition counts and the two reported rates."""
    q = bad.agg(F.count(F.lit(1)).alias("n_bad"),
                F.count_if(F.col("reason") == out_of_scope).alias("n_oos"))
    n = all_docs.agg(F.count(F.lit(1))).scalar()
    c = q.withColumn("n_files", n).withColumns({
        "n_in_scope": F.col("n_files") - F.col("n_oos"),
        "n_parsed": F.col("n_files") - F.col("n_bad")})
    pct = lambda e: F.when(F.col("n_in_scope") > 0, 100.0 * e / F.col("n_in_scope"))
    return c.select(
        "n_files", "n_in_scope", "n_parsed", F.col("n_bad").alias("n_quarantined"),
        pct(F.col("n_parsed")).alias("parse_rate"),
        pct(F.col("n_parsed") + F.col("n_bad") - F.col("n_oos")).alias("disposition_rate"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str],
             top: int | None = None) -> DataFrame:
    """Counts of ``col`` values per ``row`` with a row total; ties break by row key."""
    out = df.groupBy(row).agg(
        *[F.count_if(F.col(col) == v).alias(v) for v in values],
        F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), row)
    return out if top is None else out.limit(top)


def shape_census(df: DataFrame, shape: Mapping[str, Column]) -> DataFrame:
    """Count rows by computed keys (null flags, filled values)."""
    return (df.groupBy(*[e.alias(n) for n, e in shape.items()])
            .agg(F.count(F.lit(1)).alias("n")).orderBy(*shape))


def conditional_mean(df: DataFrame, keys: Sequence[str], value: str, cond: Column) -> DataFrame:
    return df.filter(cond).groupBy(*keys).agg(F.avg(value).alias("mean"),
                                              F.count(F.lit(1)).alias("n"))


def first_examples(df: DataFrame, by: str, order: Sequence[str], n: int) -> DataFrame:
    """First n rows per key: kept small by a rank limit Spark pushes below the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def dilution(df: DataFrame, conditions: Mapping[str, Column],
             by: Sequence[str] = ()) -> DataFrame:
    """Share of rows meeting each condition."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in conditions.items()])


def value_shares(df: DataFrame, label: str, value: str) -> DataFrame:
    """Each label's value and its share of the total (labels are few)."""
    total = df.agg(F.sum(value)).scalar()
    return df.select(label, value, (F.col(value) / total).alias("share"))


def grouped_means(df: DataFrame, member: str, groups: Mapping[str, Sequence[str]],
                  values: Sequence[str]) -> DataFrame:
    """Mean of per-member metrics over named member groups."""
    pairs = [F.struct(F.lit(g).alias("group"), F.lit(m).alias("m"))
             for g, ms in groups.items() for m in ms]
    tag = F.filter(F.array(*pairs), lambda p: p["m"] == F.col(member).cast("string"))
    return df.withColumn("__g", F.explode(tag)).groupBy(F.col("__g.group").alias("group")).agg(
        *[F.avg(v).alias(v) for v in values])


def version_histogram(docs: DataFrame, raw: str = "raw", path: str = "$.meta.data_version"):
    """Documents per version text."""
    v = F.coalesce(F.get_json_object(raw, path), F.lit("None")).alias("version")
    return docs.groupBy(v).agg(F.count(F.lit(1)).alias("n"))


def values_outside(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct observed values that are not allowed."""
    return df.filter(~F.col(col).isin(*allowed)).select(col).distinct()
