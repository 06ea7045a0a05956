"""Semantic document indexing and retrieval as Spark jobs."""
