"""Spark-first analytics engine for code-risk findings, scan history and text corpora."""

__version__ = "3"
