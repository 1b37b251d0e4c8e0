"""Sealed records and searchable sealed indexes as Spark DataFrame jobs."""
