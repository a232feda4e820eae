"""Interaction-graph recommendations as Spark jobs."""
