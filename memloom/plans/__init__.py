"""Pipelines of operators over the whole state."""
