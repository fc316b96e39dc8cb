"""Scans, sinks, schemas and lookup tables."""
