"""Registry of every query bound to the driver tables, with its DuckDB oracle."""

from __future__ import annotations

import importlib

_MODULES = tuple(f"faultline.plans.{m}" for m in ("retrieval", "texts", "corpus", "truth", "code", "calls", "repair", "stages", "options"))


def _load():
    qs, sql = {}, {}
    for name in _MODULES:
        m = importlib.import_module(name)
        qs.update(m.QUERIES)
        sql.update(getattr(m, "ORACLE", {}))
    return qs, sql


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
