"""Queries over the driver's tables and their SQL oracles."""

from __future__ import annotations

from tessera.queries import audits, evaluation, features, manifest, sequences, vectors

_MODULES = (manifest, vectors, sequences, evaluation, audits, features)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "prototype_predict"
