"""Snapshot-catalog analytics on Spark."""
