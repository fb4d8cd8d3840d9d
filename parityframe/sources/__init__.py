"""Scans and sinks (A1, A4) plus the loader for the driver's tables."""

from parityframe.sources.io import (
    TABLES, read_csv, read_parquet, read_table, write_artifact, tables,
)

__all__ = ["TABLES", "read_csv", "read_parquet", "read_table", "write_artifact", "tables"]
