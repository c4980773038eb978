"""Typed decisions over tables and streams, as Spark DataFrame operations."""
