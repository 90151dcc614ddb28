"""Sources of the retrieval pipeline."""
