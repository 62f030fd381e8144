"""Operators of a training-data pipeline, one per module."""
