"""Operators on collections: find, pipelines, writes, routing, cursors, counters."""
