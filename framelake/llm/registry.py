"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from framelake.llm import oracles, queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}
ORACLES = dict(oracles.SQL)
