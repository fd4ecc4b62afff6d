"""Typed looks into JSON held as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse(raw: Column) -> Column:
    """Variant of a JSON text, null when it does not parse."""
    return F.try_parse_json(raw)


def as_object(v: Column) -> Column:
    """map<string, variant>, null unless the value is an object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    """array<variant>, null unless the value is an array."""
    return F.try_variant_get(v, "$", "array<variant>")


def text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def member(obj: Column, key: str) -> Column:
    return F.try_element_at(obj, F.lit(key))


def has(obj: Column, key: str) -> Column:
    return F.map_contains_key(obj, F.lit(key))


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def truthy(v: Column) -> Column:
    """Would a plain truth test accept the value?  Zero, nothing and what is empty are false."""
    k = kind(v)
    return F.coalesce(
        F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(k == "STRING", text(v) != "")
        .when(k.startswith("OBJECT"), F.size(as_object(v)) > 0).when(k.startswith("ARRAY"), F.size(as_array(v)) > 0)
        .otherwise(F.try_variant_get(v, "$", "double") != 0), F.lit(False))


def whole(v: Column) -> Column:
    """Whole number a number, a truth value or a text of digits stands for; null for anything else."""
    k, t = kind(v), F.trim(text(v))
    return (
        F.when(k == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
        .when((k == "STRING") & t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
        .when(k.startswith("DECIMAL") | (k == "DOUBLE"), F.try_variant_get(v, "$", "double").cast("bigint")))


def names(v: Column) -> Column:
    """Texts that going through the value yields: items, keys or characters; null if it cannot be gone through."""
    k = kind(v)
    return (
        F.when(k.startswith("ARRAY"), F.transform(as_array(v), lambda x: F.coalesce(text(x), F.lit("?"))))
        .when(k.startswith("OBJECT"), F.map_keys(as_object(v)))
        .when(k == "STRING", F.filter(F.split(text(v), ""), lambda c: c != "")))


def not_int(v: Column) -> Column:
    """Anything but a whole number; booleans are not numbers."""
    return kind(v) != "BIGINT"


def not_str(v: Column) -> Column:
    return kind(v) != "STRING"
