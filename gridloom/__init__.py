"""Ordered, block-partitioned distributed collections on Spark."""
