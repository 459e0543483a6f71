"""Schemas, the versioned state on disk, and providers of outside results."""
