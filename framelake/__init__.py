"""Spark-native tables and streams for machine-vision capture and evaluation data."""

from framelake.session import build_session, shared_dir, truncate_lineage

__all__ = ["build_session", "shared_dir", "truncate_lineage"]
