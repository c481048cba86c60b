"""Structured Streaming forms of the rollups and alerts."""
