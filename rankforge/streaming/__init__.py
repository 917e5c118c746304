"""Structured Streaming forms of ingest, re-ranking and manifests."""
