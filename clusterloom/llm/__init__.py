"""Operators for training-data pipelines: tokenizing, filtering, deduplicating, scoring, sharding."""
