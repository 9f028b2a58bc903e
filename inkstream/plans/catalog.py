"""Registered queries and the DuckDB SQL of each, by area."""

from __future__ import annotations

from inkstream.plans import archives, commands, content, editorial, entities, evidence, feeds, market, press, registry, review, state, stock, storage

MODULES = (archives, commands, content, editorial, entities, evidence, feeds, market, press, registry, review, state, stock, storage)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
