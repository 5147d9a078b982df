"""Byte formats and their Spark data sources."""
