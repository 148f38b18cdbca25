"""Queries of the review operators by name, and their SQL."""

from __future__ import annotations

from .plans import blocks, journal, nodes, online, records, relational, sync, text, trees
from .plans.tables import oracle, sql_query

QUERIES = text.QUERIES | blocks.QUERIES | {name: sql_query(sql) for name, sql in relational.QUERIES.items()} | nodes.QUERIES | journal.QUERIES | records.QUERIES | trees.QUERIES | sync.QUERIES | online.QUERIES
ORACLES: dict[str, str] = text.SQL | blocks.SQL | {name: oracle(relational.ORACLES.get(name, sql)) for name, sql in relational.QUERIES.items()} | journal.SQL | records.SQL | trees.SQL | sync.SQL | online.SQL
