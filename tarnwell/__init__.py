"""Tarnwell: hybrid document retrieval and its evaluation as Spark plans."""
