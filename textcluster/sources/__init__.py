"""Readers: record scans over XML and delimited text files, staged Parquet, driver tables."""
