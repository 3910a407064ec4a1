"""Composed pipelines and the queries over the driver's tables."""
