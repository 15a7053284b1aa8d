"""Readers and writers: Parquet tables, JSON lines, CSV, file streams and the versioned table store."""
