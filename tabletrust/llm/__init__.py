"""Operators for training-data pipelines, and their queries."""

from tabletrust.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
