"""Temporal property-graph analytics on PySpark."""
