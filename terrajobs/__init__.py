"""Batch jobs for territorial data, written as Spark DataFrame transformations."""
