"""Tarnwell: retrieval analytics as PySpark DataFrame plans."""
