"""Spatial retrieval, repeated-observation maps and trajectory analytics as Spark DataFrame jobs."""
