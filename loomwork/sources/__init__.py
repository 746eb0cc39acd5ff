"""Readers."""

from loomwork.sources.tables import table

__all__ = ["table"]
