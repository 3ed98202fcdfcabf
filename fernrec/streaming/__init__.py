"""Incremental ingestion of review text (S1 + S2 on a file stream).

The reference trains offline only; this package adds no model operator. It
runs the same record reader and parser as ``sources.text`` as a Structured
Streaming query, so review files dropped into a folder are appended to the
interaction table that preparation reads.
"""

from .ingest import interaction_stream, ingest_review_files

__all__ = ["interaction_stream", "ingest_review_files"]
