"""Structured Streaming forms of landing (L1) and alerting (L2)."""
