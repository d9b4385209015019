"""The registered queries of the document-analytics operators and their SQL."""

from __future__ import annotations

from vellum.plans import corpus_queries, structure_queries, text_queries

QUERIES = {**text_queries.QUERIES, **corpus_queries.QUERIES, **structure_queries.QUERIES}
ORACLE_SQL = {**text_queries.ORACLE_SQL, **corpus_queries.ORACLE_SQL, **structure_queries.ORACLE_SQL}
