"""Readers and writers: tables in wide and long form, the interchange format, Parquet stores, relational views."""
