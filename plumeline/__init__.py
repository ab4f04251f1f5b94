"""Plumeline: forecasting, scenarios and process scoring over many series, as Spark DataFrame jobs."""

__version__ = "0.1.0"
