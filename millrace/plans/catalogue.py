"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("pages", "records", "runs", "diagnostics", "fixtures", "markup", "streams", "deliveries")


def _found():
    for name in _MODULES:
        try:
            yield import_module(f"{__package__}.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{name}":
                raise


def queries() -> dict:
    return {k: f for m in _found() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _found() for k, s in m.SQL.items()}
