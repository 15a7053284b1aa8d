"""Structured Streaming jobs: once-per-file ingestion and idempotent table updates."""
