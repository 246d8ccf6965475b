"""Operators of a training-data pipeline: counting, identifying, packing, searching, sharding, scoring and joining text."""
