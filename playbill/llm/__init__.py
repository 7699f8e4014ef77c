"""Operators of a training-data pipeline: filtering, deduplication, mixing, formatting and archives."""
