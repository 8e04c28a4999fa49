"""Queries on the driver's tables, one or more for each operator, with the SQL that tells the same rows."""

from . import chunks, fusion, index, parsing, results, search, segments, upkeep
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "chunks", "fusion", "index", "parsing", "results", "search", "segments", "upkeep"]
