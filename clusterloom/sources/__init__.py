"""Readers and writers for sequence, annotation, alignment and prediction files."""
