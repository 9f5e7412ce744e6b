"""Readers and writers: Parquet tables, JSON collections, paged stores."""
