"""All queries and oracles, collected from the modules that define them."""

from __future__ import annotations

from . import amounts, ingest, keys, reports
from .reports import report_accumulated as flagship

_MODULES = (ingest, keys, amounts, reports)

QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES", "flagship"]
