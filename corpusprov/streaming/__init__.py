"""Incremental ingestion with the file source of Structured Streaming."""

from corpusprov.streaming.ingest import current_totals, ingest_counts, ingest_totals, ingest_urls, running_counts

__all__ = ["current_totals", "ingest_counts", "ingest_totals", "ingest_urls", "running_counts"]
