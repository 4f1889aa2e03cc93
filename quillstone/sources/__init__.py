"""Scans: parquet tables, JSON chunk files, CSV, HTML and audit logs."""
