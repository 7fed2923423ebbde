"""Typed column filters: a list of criteria compiled once to one condition on the plan.

A cell is an array of raw values; blanks are removed first. Criteria are checked on the driver
before anything is read, and all are ANDed. Positive text and number tests hold if any value
passes; negative ones only if all do.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.identifiers import identifier_key
from tessera.functions.numbers import let, rank_value

SET_OPS = ("in", "not_in")
TEXT_OPS = ("contains", "not_contains", "starts_with", "ends_with", "eq", "ne")
ORDER_OPS = ("gt", "gte", "lt", "lte")
EMPTY_OPS = ("empty", "not_empty")
OPS = (*SET_OPS, *TEXT_OPS, *ORDER_OPS, *EMPTY_OPS, "band")
BANDS = ("strong", "medium", "none")
LIMIT = 20


class FilterError(ValueError):
    """A criterion that no table can answer."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str | float | None = None
    values: tuple[str, ...] = ()
    include_empty: bool | None = None


def checked(filters: list[Filter], columns: dict[str, str]) -> list[Filter]:
    """Refuse unknown columns and operators, missing or inexact operands. columns: name to kind (text, identifier or band)."""
    if len(filters) > LIMIT:
        raise FilterError("too many filters")
    for f in filters:
        if f.column not in columns:
            raise FilterError(f"unknown column {f.column!r}")
        if f.op not in OPS:
            raise FilterError(f"unknown operator {f.op!r}")
        if f.op in ORDER_OPS and not (isinstance(f.value, (int, float)) and not isinstance(f.value, bool) and math.isfinite(f.value)) and not re.fullmatch(r"\s*(?:[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?|\+{1,8}|[A-Z])\s*", str(f.value), re.ASCII):
            raise FilterError("an order needs one exact value")
        if f.op in TEXT_OPS and (f.value is None or not str(f.value).strip()):
            raise FilterError("the operator needs a value")
        if f.op in SET_OPS and not f.values and f.include_empty is None:
            raise FilterError("the operator needs values")
        if f.op == "band" and (f.value not in BANDS or columns[f.column] != "band"):
            raise FilterError("the column has no bands")
    return filters


def present(cell: Column) -> Column:
    return F.filter(F.coalesce(cell, F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.trim(v) != ""))


def equal(value: Column, operand: str) -> Column:
    """Numeric where both parse to one kind, else by small letters."""
    other = rank_value(F.lit(operand))
    text = F.lower(F.trim(value)) == F.lower(F.trim(F.lit(operand)))
    return let(rank_value(value), lambda mine: F.when(mine.isNotNull() & other.isNotNull() & (mine["kind"] == other["kind"]), mine["value"] == other["value"]).otherwise(text))


def condition(f: Filter, kind: str = "text", bands: Column | None = None) -> Column:
    """One criterion on the array column of its name; bands: the array of the cell's strength bands."""
    values = present(F.col(f"`{f.column}`"))
    empty = F.size(values) == 0
    low = lambda v: F.lower(v)
    operand = "" if f.value is None else str(f.value)
    folded = operand.lower()
    if f.op in EMPTY_OPS:
        return empty if f.op == "empty" else ~empty
    if f.op == "band":
        return F.array_contains(F.when(F.size(bands) > 0, bands).otherwise(F.array(F.lit("none"))), operand)
    if f.op in SET_OPS:
        blank = f.include_empty if f.include_empty is not None else f.op == "not_in"
        wanted = F.array(*[F.lit(v.strip()) for v in f.values]) if f.values else F.array().cast("array<string>")
        own = F.transform(values, lambda v: F.trim(v))
        if kind == "identifier":
            keys = lambda a: F.transform(a, lambda v: F.when(identifier_key(v) != "", identifier_key(v)).otherwise(F.lower(v)))
            own, wanted = keys(own), keys(wanted)
        hit = F.arrays_overlap(own, wanted)
        return F.when(empty, F.lit(blank)).otherwise(hit if f.op == "in" else ~hit)
    if f.op in ORDER_OPS:
        other = rank_value(F.lit(operand))
        test = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[f.op]
        ranks = F.filter(F.transform(values, rank_value), lambda r: r.isNotNull())
        return F.exists(ranks, lambda r: (r["kind"] == other["kind"]) & test(r["value"], other["value"]))
    return {
        "contains": lambda: F.exists(values, lambda v: F.contains(low(v), F.lit(folded))),
        "not_contains": lambda: F.forall(values, lambda v: ~F.contains(low(v), F.lit(folded))),
        "starts_with": lambda: F.exists(values, lambda v: F.startswith(low(v), F.lit(folded))),
        "ends_with": lambda: F.exists(values, lambda v: F.endswith(low(v), F.lit(folded))),
        "eq": lambda: F.exists(values, lambda v: equal(v, operand)),
        "ne": lambda: F.forall(values, lambda v: ~equal(v, operand)),
    }[f.op]()


def matching(table: DataFrame, filters: list[Filter], columns: dict[str, str], bands: dict[str, Column] | None = None) -> DataFrame:
    """Rows that meet all criteria."""
    for f in checked(filters, columns):
        table = table.where(condition(f, columns[f.column], (bands or {}).get(f.column)))
    return table


def search(table: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which one of the joined columns contains the text, whatever its case; wildcards are plain text."""
    if not text.strip():
        return table
    return table.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def draft(kind: str, column: str, mode: str, text: str = "", chosen: tuple[str, ...] = (), all_but: bool = False) -> Filter:
    """A user's choice as a filter: a checklist (some, or all but some) or one test of a kind that allows it."""
    allowed = {"number": (*ORDER_OPS, "eq", "ne", *EMPTY_OPS), "text": (*TEXT_OPS, *EMPTY_OPS), "presence": EMPTY_OPS}
    if mode == "choices":
        return Filter(column, "not_in" if all_but else "in", values=tuple(chosen))
    if mode not in allowed[kind]:
        raise FilterError(f"{mode!r} is no test of a {kind} column")
    return Filter(column, mode, None if mode in EMPTY_OPS else text)


def replaced(filters: list[Filter], new: Filter | None, column: str) -> list[Filter]:
    """One filter for each column: the new one takes the old one's place."""
    return [f for f in filters if f.column != column] + ([new] if new else [])
