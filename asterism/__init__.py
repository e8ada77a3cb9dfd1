"""Signed-coordinate catalog engine on PySpark."""
