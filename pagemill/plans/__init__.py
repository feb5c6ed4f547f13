"""Queries: each of them a function of (spark, sf_dir)."""

from . import operator_queries, page_queries, program_queries, scalars
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "operator_queries", "page_queries", "program_queries", "scalars"]
