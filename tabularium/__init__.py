"""Spark-first refinement and analysis of large document collections."""
