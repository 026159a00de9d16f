"""Logical tables from the given Parquet files, registered queries and their SQL."""
