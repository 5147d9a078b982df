"""Incremental mirroring and request resolution with Structured Streaming."""
