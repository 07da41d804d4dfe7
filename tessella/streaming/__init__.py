"""Structured Streaming forms of per-key operators."""
