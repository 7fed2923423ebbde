"""Exact context identities: digests of compact JSON, nothing merged or converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def context_id(*parts: Column) -> Column:
    """SHA-256 of the parts as a compact JSON array; a null part stays null in it."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def map_digest(values: Column) -> Column:
    """SHA-256 of a map's entries by key."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values)))), 256)


def compared(left: Column, right: Column, required: list[str]) -> Column:
    """conflict, incomplete or complete: two maps of known conditions over the required keys."""
    conflict, incomplete = F.lit(False), F.lit(False)
    for key in required:
        a, b = left[key], right[key]
        conflict = conflict | F.coalesce(a != b, F.lit(False))
        incomplete = incomplete | a.isNull() | b.isNull()
    return F.when(conflict, "conflict").when(incomplete, "incomplete").otherwise("complete")
