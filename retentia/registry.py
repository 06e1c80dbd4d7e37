"""Queries of the library operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import catalog, q_aggregates, q_ingest, q_joins, q_pedigree, q_search, q_splittree, q_traces  # noqa: F401

QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL
