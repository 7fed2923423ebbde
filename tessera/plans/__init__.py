"""Registered queries by family, each with DuckDB SQL where SQL can express it."""

from . import aggregates, documents, filters, functions, joins, sources, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
