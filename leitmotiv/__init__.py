"""Motif discovery over multidimensional series, written for Spark's DataFrame and SQL API."""
