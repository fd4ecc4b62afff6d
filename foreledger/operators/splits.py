"""Temporal splits: bounds, assignment, integrity, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Split labels in time order and their cumulative shares.
SPLITS = ("train", "val", "test")
SHARES = (0.8, 0.9)


def temporal_bounds(
    groups: DataFrame, date_col: str, shares: tuple[float, float] = SHARES
) -> DataFrame:
    """One row (b1, b2): the dates at sorted positions floor(share*n), zero-based.

    Dates are counted first; the running count then sees one entry per calendar
    day, however many groups there are.
    """
    days = groups.groupBy(F.col(date_col).alias("d")).agg(F.count(F.lit(1)).alias("c")).filter("d is not null")
    ordered = days.agg(F.sort_array(F.collect_list(F.struct("d", "c"))).alias("ds"), F.sum("c").alias("n"))

    def at(share: float) -> Column:
        rank = F.floor(F.col("n") * share)
        start = F.named_struct(F.lit("seen"), F.lit(0).cast("long"), F.lit("d"), F.lit(None).cast("date"))
        return F.aggregate("ds", start, lambda a, x: F.named_struct(
            F.lit("seen"), a["seen"] + x["c"],
            F.lit("d"), F.when(a["d"].isNull() & (a["seen"] + x["c"] > rank), x["d"]).otherwise(a["d"])))["d"]

    return ordered.select(*[at(s).alias(f"b{i + 1}") for i, s in enumerate(shares)])


def split_label(date: Column, b1: Column, b2: Column) -> Column:
    return F.when(date < b1, SPLITS[0]).when(date < b2, SPLITS[1]).otherwise(SPLITS[2])


def assign_split(
    df: DataFrame, date_col: str, bounds: DataFrame, out: str = "temporal_split"
) -> DataFrame:
    """Label rows against a one-row bounds frame.

    The two dates are fetched and become literals, so a filter on the label
    turns into a date range the scan can use.
    """
    b = bounds.select("b1", "b2").first()
    return df.withColumn(out, split_label(F.col(date_col), F.lit(b["b1"]), F.lit(b["b2"])))


def date_ranges(groups: DataFrame, date_col: str, split_col: str = "temporal_split") -> DataFrame:
    return groups.groupBy(split_col).agg(
        F.min(date_col).alias("lo"), F.max(date_col).alias("hi"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def split_metadata(
    groups: DataFrame, facts: DataFrame, date_col: str, fmt_col: str | None = None,
    split_col: str = "temporal_split",
) -> DataFrame:
    """Date range, group count and fact count per split (and per format)."""
    extra = [fmt_col] if fmt_col else []
    g = groups.groupBy(*extra, split_col).agg(
        F.min(date_col).alias("lo"), F.max(date_col).alias("hi"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    f = facts.groupBy(*extra, split_col).agg(F.count(F.lit(1)).alias("n_facts"))
    return g.join(f, [*extra, split_col], "left").fillna(0, ["n_facts"])


def split_violations(
    groups: DataFrame, facts: DataFrame, key: str, date_col: str,
    split_col: str = "temporal_split",
) -> DataFrame:
    """All split defects as rows (check, subject, detail); empty when sound.

    Unknown labels, a group in two splits, facts disagreeing with their
    dimension, splits out of time order, empty splits.
    """
    text = lambda *cs: F.concat_ws(" ", *cs)
    labels = groups.select(split_col).distinct()
    known = groups.sparkSession.createDataFrame([(s,) for s in SPLITS], f"{split_col} string")
    unknown = labels.join(F.broadcast(known), split_col, "left_anti").select(
        F.lit("unknown_label").alias("check"), F.col(split_col).alias("subject"),
        F.lit("").alias("detail"),
    )
    pairs = facts.select(key, split_col).dropDuplicates()
    multi = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("several_splits").alias("check"), F.col(key).cast("string").alias("subject"),
        F.col("n").cast("string").alias("detail"),
    )
    dim = groups.select(key, F.col(split_col).alias("dim_split"))
    disagree = pairs.join(dim, key).filter(F.col(split_col) != F.col("dim_split")).select(
        F.lit("disagreement").alias("check"), F.col(key).cast("string").alias("subject"),
        text(F.col(split_col), F.col("dim_split")).alias("detail"),
    )
    day = F.col(date_col)
    per = [F.max(F.when(F.col(split_col) == s, day)).alias(f"hi_{s}") for s in SPLITS] + [
        F.min(F.when(F.col(split_col) == s, day)).alias(f"lo_{s}") for s in SPLITS
    ]
    r = groups.agg(*per)
    checks = [
        F.when(F.col(f"lo_{s}").isNull(), F.struct(
            F.lit("empty_split").alias("check"), F.lit(s).alias("subject"),
            F.lit("").alias("detail")))
        for s in SPLITS
    ] + [
        F.when(~(F.col(f"hi_{a}") < F.col(f"lo_{b}")), F.struct(
            F.lit("time_order").alias("check"), F.lit(f"{a}<{b}").alias("subject"),
            text(F.col(f"hi_{a}").cast("string"), F.col(f"lo_{b}").cast("string")).alias("detail")))
        for a, b in zip(SPLITS, SPLITS[1:])
    ]
    order = r.select(F.explode(F.array_compact(F.array(*checks))).alias("v")).select("v.*")
    return unknown.unionByName(multi).unionByName(disagree).unionByName(order)
