"""Pipelines, and queries over the driver tables."""
