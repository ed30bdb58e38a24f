"""Operators for training-data pipelines: extraction, dedup, filters, models, encoding."""
