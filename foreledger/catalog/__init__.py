"""Queries over the shared tables, each with the SQL that checks it."""

from importlib import import_module

_MODULES = (
    "flagship", "windows", "splits", "scoring", "tables", "resample", "documents", "census",
    "streams", "modeling")


def _merged(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        part = getattr(import_module(f"foreledger.catalog.{m}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
