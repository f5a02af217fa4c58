"""Hybrid retrieval and console-log analytics as Spark DataFrame plans."""
