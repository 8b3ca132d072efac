"""Retrieval over structured documents, and training-data preparation, as Spark plans."""
