"""Composed plans: the batch pipeline, the query registry and its DuckDB oracle."""
