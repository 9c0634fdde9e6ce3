"""Gridded-data analytics and corpus preparation on PySpark."""
