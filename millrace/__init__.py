"""Catalog, extent and integrity analytics as Spark DataFrame functions."""
