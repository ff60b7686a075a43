"""Schemas, tables, the store and page readers."""
