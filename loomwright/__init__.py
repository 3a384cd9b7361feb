"""Spark-first analytics for multimodal and text corpora."""
