"""Retail warehouse analytics as PySpark DataFrame operators."""
