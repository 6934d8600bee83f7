"""Readers, writers and source-text extractors."""
