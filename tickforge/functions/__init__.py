"""Column helpers: time buckets, identifiers, bands, formatting."""
