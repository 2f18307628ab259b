"""Readers, partitioned writers and the state catalogue."""
