"""Queries over the given parquet tables, each with the SQL that states its answer."""

from .catalog import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
