"""Synthetic tables from declared schemas, assertions over them, and reviewed repair of bad values, on Spark."""
