"""Whole pipelines: screening a set of batches, training a model."""
