"""Relational planning and analytics on PySpark."""
