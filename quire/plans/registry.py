"""All queries of the document engine, and the SQL that must give the same rows."""

from __future__ import annotations

import inspect

from quire.plans import oracles, queries

#: Public functions of (spark, sf_dir) in ``queries``; the names of helpers are excluded.
_HELPERS = {"blocks", "translated", "scored"}
QUERIES = {n: f for n, f in vars(queries).items() if inspect.isfunction(f) and f.__module__ == queries.__name__ and n not in _HELPERS and not n.startswith("_")}
ORACLE_SQL = {n: sql for n, sql in oracles.ORACLE_SQL.items() if n in QUERIES}
