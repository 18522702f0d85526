"""Operators of a training-data pipeline: independent modules and their queries."""
