"""Corpus processing, retrieval and training-data preparation as Spark DataFrame operators."""
