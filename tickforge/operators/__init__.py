"""Reusable DataFrame operators that Spark does not ship: as-of, spine, islands, chunked windows, ranks."""
