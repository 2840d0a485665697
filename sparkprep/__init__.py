"""Tabular data preparation, profiling, retrieval and model screening as Spark jobs."""

__version__ = "0.1.0"
