"""Cartomill: code-graph analytics on PySpark."""
