"""Relational and graph operators over node, edge and document tables."""
