"""Parquet, Arrow IPC, CSV and JSON."""
