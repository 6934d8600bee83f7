"""Structured Streaming jobs that keep the batch tables current."""
