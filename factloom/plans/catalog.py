"""Every named query of the library, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from factloom.plans import answering, coverage, facts, filtering, graphs, ingest, searching, streams, tables, texts
from factloom.plans.registry import Query

MODULES = (coverage, filtering, texts, graphs, ingest, searching, facts, answering, streams, tables)
QUERIES: dict[str, Query] = {k: f for m in MODULES for k, f in m.CATALOGUE.queries.items()}
SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.CATALOGUE.sql.items()}
