"""Operators for training-data pipelines; ``queries`` binds them to the given tables."""
