"""All queries of the library and their SQL."""

from __future__ import annotations

from .queries import chat_queries, document_queries


def queries():
    return document_queries.QUERIES | chat_queries.QUERIES


def oracle_sql():
    return document_queries.SQL | chat_queries.SQL
