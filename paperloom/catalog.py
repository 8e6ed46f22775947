"""All queries of the library by name, and the SQL that they are held against."""

from __future__ import annotations

from .plans import corpus, entities, metadata, services

PARTS = (metadata, entities, corpus, services)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
