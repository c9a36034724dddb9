"""Appends by micro-batch, sorted runs with compaction, and standing queries."""
