"""Facets: the distinct values of a column, counted by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.identifiers import natural_key
from tessera.functions.numbers import parsed, rank_value
from tessera.functions.text import casefold

from .filters import Filter, matching, present
from .ranking import workbook_order


def values_of(table: DataFrame, column: str) -> DataFrame:
    """value, n: how many rows hold each trimmed value; rows without one count under null."""
    own = F.transform(present(F.col(column)), lambda v: F.trim(v))
    return table.select(F.explode_outer(F.array_distinct(own)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def facet(table: DataFrame, column: str, page: int = 1, size: int = 200, search: str = "", kind: str = "text") -> DataFrame:
    """value, n: one page of a column's values with their rows, in the order in which the column sorts (identifiers naturally, else
    numbers and grades before text); rows without a value count under null, at the end. search keeps values that hold its text, and no null."""
    counted = values_of(table, column)
    if search:
        counted = counted.where(casefold(F.col("value")).contains(search.casefold()))
    if kind == "identifier":
        keyed, order = counted.withColumn("__key", natural_key(F.col("value"))), [F.col("value").isNull(), F.col("__key"), F.col("value")]
    else:
        keyed, order = workbook_order(counted, "value", ["value"])
    return keyed.orderBy(*order).offset((page - 1) * size).limit(size).select("value", "n")


def facet_totals(table: DataFrame, column: str, search: str = "") -> DataFrame:
    """One row: distinct values that hold the search's text, rows without a value, all rows."""
    counted = values_of(table, column)
    held = casefold(F.col("value")).contains(search.casefold()) if search else F.col("value").isNotNull()
    return counted.agg(F.count_if(held).alias("total"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("empty_count")).crossJoin(table.agg(F.count("*").alias("matching_rows")))  # a row each


def facet_of(table: DataFrame, column: str, filters: list[Filter], columns: dict[str, str], page: int = 1, size: int = 200, search: str = "") -> DataFrame:
    """The facet of a filtered table, leaving out the column's own filters so that other choices stay visible."""
    rows = matching(table, [f for f in filters if f.column != column], columns)
    return facet(rows, column, page, size, search, "identifier" if columns.get(column) == "identifier" else "text")


def facet_kind(table: DataFrame, column: str, always_number: bool = False) -> DataFrame:
    """number or text, by what more rows' values are (a value counts once in a row); a property or a source is always a number.

    Each distinct value is read once.
    """
    values = parsed(values_of(table, column).where("value is not null"), "value", "__r", rank_value)
    number = F.coalesce(F.col("__r.kind") == "numeric", F.lit(False))
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    counted = values.agg(of(number).alias("n_numbers"), of(~number).alias("n_texts"))
    return counted.select("n_numbers", "n_texts", F.when(F.lit(always_number) | (F.col("n_numbers") > F.col("n_texts")), "number").otherwise("text").alias("kind"))
