"""Nested-event analytics on Spark."""
