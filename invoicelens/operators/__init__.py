"""Indicators, tools, audits, vector search and evaluation."""
