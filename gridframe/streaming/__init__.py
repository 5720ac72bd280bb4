"""Structured Streaming form of the conversion job (incremental ingest)."""

from gridframe.streaming.ingest import start_ingest  # noqa: F401
