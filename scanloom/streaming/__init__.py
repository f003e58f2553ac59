"""Structured Streaming jobs over the lifecycle log."""
