"""Batch analytics over drug reference data, written as Spark DataFrame jobs."""
