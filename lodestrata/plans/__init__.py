"""Fixtures over the star-schema tables, plan rewrites, and the queries with their oracles."""
