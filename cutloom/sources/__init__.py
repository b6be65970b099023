"""Readers and writers."""

from cutloom.sources.tables import table

__all__ = ["table"]
