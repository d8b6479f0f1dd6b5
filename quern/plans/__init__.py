"""Queries and their SQL: importing this registers all of the engine's own."""

from quern.plans import accounts, chunks, lookups, pages, records, retrieval, streams, texts, uploads
from quern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "accounts", "chunks", "lookups", "pages", "records", "retrieval", "streams", "texts", "uploads"]
