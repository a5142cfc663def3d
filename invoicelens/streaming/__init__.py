"""Incremental form of the sales load."""
