"""Structured Streaming versions of the additive metrics."""
