"""Operators for training-data pipelines: ten methods over tables of documents, pages and vectors, each with one registered query."""
