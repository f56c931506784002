"""Spark jobs over API-symbol tables, release histories and documentation corpora."""
