"""Functions of the retrieval pipeline."""
