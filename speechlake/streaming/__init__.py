"""Structured Streaming jobs, and the same over stored chunks."""
