"""Relational operators: parsing, ingest checks, deduplication, queries, aggregates, store, spool."""
