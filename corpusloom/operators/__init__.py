"""Operators of the retrieval pipeline."""
