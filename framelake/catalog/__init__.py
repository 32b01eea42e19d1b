"""Checked queries, one module per family."""

from framelake.catalog import aggregates, functions, geometry, joins, models, projections, sources, streams, windows  # noqa: F401
from framelake.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
