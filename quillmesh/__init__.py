"""Spark-native batch and streaming jobs for text embedding, reranking, rewriting and their evaluation."""

__version__ = "0.1.0"
