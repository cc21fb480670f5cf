"""Sequence and ordered-cluster analytics as Spark DataFrame operators."""
