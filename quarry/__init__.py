"""Quarry: traceability analytics over quads and tables, written for Spark."""
