"""Readers, writers, load jobs and the mapping of the sample tables to the fact."""
