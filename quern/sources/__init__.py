"""Readers that turn files into the store's DataFrames."""

from quern.sources.tables import table

__all__ = ["table"]
