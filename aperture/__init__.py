"""Spark-first analytics over embedding, slide, score and retrieval tables."""
