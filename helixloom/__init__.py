"""Windowed k-mer analytics on Spark."""
