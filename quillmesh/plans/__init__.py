"""Compositions of operators: serving, retrieval, and the query catalogue."""
