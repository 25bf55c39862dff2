"""Operators for preparing training text: Spark jobs over `documents` and `embeddings`."""
