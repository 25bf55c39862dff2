"""Catalogue analytics and corpus preparation on PySpark."""
