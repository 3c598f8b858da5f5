"""Readers of tables and text files."""

from causeway.sources.tables import read_table, spread

__all__ = ["read_table", "spread"]
