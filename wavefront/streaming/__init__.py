"""Edges that arrive over time (an extension: the benchmark itself is batch only)."""

from .ingest import edge_counts, ingest_edges

__all__ = ["edge_counts", "ingest_edges"]
