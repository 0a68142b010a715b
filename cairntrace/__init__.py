"""Batch-cluster job-trace analytics as Spark DataFrame jobs."""
