"""Repeated-pattern analytics over time series, as Spark jobs."""
