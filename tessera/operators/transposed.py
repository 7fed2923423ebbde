"""Tables whose compounds stand across: the row of compounds is found in each table, and the table is turned.

A table is cells (table, row, col, text), rows and columns from 0. A null text is covered by the cell to its
left, of a merged heading; an empty one is a cell without text. Nothing is read from the order of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.headers import count_role, field_name, metrics, suffixed
from tessera.functions.identifiers import PREFIX, PRINTED, identifier_key
from tessera.functions.numbers import let, parsed
from tessera.functions.text import is_value
from tessera.sources.scratch import cut

from .text_tables import CONTROL

#: The row of compounds is one of the first rows.
FIRST_ROWS = 3


def declared_compound(text: Column) -> Column:
    """The compound that a heading declares: a label word and an identifier, or a control; else null.

    A number alone may be a dose or a time, so it declares nothing.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    named = bare.rlike(rf"(?i)^{PREFIX}{PRINTED}$")
    return F.when(bare.rlike(rf"(?i)^{CONTROL}$"), bare).when(named, F.concat(F.lit("Compound "), identifier_key(bare)))


def heading_signs(text: Column) -> Column:
    """(blank, fits, metric) of a row's heading: whether it is one metric or a count, and whether it names a metric."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return let(F.size(metrics(text)), lambda n: F.struct(blank.alias("blank"), ((n == 1) | count_role(text).isNotNull()).alias("fits"), (n > 0).alias("metric")))


def row_field(heading: Column) -> Column:
    """(count, field) of (title, own, i): what a row of a column counts, and its field."""
    return F.struct(count_role(heading["own"]).alias("count"), field_name(F.concat_ws(" ", heading["title"], heading["own"]), heading["i"]).alias("field"))


def header_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header_row): the first of a table's first rows whose own heading is blank, with a declared compound, and under which every row's
    heading is one metric or a count, and one at least a metric. Tables without one are absent.

    Nothing is gathered by row: cells pass by the headings that fit one after the other, and those of a row without one spoil the rows above.
    """
    headings = parsed(cells.where("col = 0").select(*keys, "row", "text"), "text", "__h", heading_signs).select(*keys, "row", "__h.*")
    fitting = headings.where("fits").select(*keys, "row")
    spoiled = cells.join(fitting.hint("shuffle_hash"), [*keys, "row"], "left_anti").select(*keys, F.col("row").alias("spoiled"))
    metric = headings.where("metric").select(*keys, F.col("row").alias("metric_row"))
    limits = spoiled.unionByName(metric, allowMissingColumns=True).groupBy(*keys).agg(F.max("spoiled").alias("spoiled"), F.max("metric_row").alias("metric_row"))
    first = F.col("row") < FIRST_ROWS
    declared = cells.where(first & (F.col("col") != 0) & declared_compound(F.col("text")).isNotNull()).select(*keys, "row")
    possible = headings.where(first & F.col("blank")).select(*keys, "row").join(declared.hint("shuffle_hash"), [*keys, "row"], "left_semi").join(limits, keys)
    return possible.where("row >= spoiled and row < metric_row").groupBy(*keys).agg(F.min("row").alias("header_row"))


def under_headers(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The cells (keys, row, col, text), made once since they are looked through several times, and the ``header_rows`` of their tables.

    Cells meet these, their columns and their headings by hash joins, whose hashed side is the one row of a table, column or heading, so no cells are sorted.
    """
    own = cut(cells.select(*keys, "row", "col", "text"), "cells")
    return own, header_rows(own, keys)


def transposed_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, row, cpd, field, count, value, needs_review): a row for each declared column and each row of values under it.

    The field joins the headings above the column, merged ones included, with the row's heading; equal ones of a column are told
    apart by the row's place. count names what a row of counts counts; these are no measurements and need no review.
    """
    own, headers = under_headers(cells, keys)
    headers = cut(headers, "headers").hint("shuffle_hash")
    first = own.where(F.col("row") < FIRST_ROWS).join(headers, keys)
    columns = first.where("row = header_row and col > 0").select(*keys, "col", declared_compound(F.col("text")).alias("cpd")).where("cpd is not null")
    along = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = first.where((F.col("row") < FIRST_ROWS - 1) & (F.col("row") < F.col("header_row"))).withColumn("heading", F.trim(F.last("text", ignorenulls=True).over(along))).where("col > 0 and heading <> ''")
    titles = above.groupBy(*keys, "col").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "heading"))), lambda x: x["heading"])), " ").alias("title"))
    columns = columns.join(titles, [*keys, "col"], "left").hint("shuffle_hash")
    heading = own.where("col = 0").join(headers, keys).where("row > header_row").select(*keys, "row", F.coalesce("text", F.lit("")).alias("own"), (F.col("row") - F.col("header_row")).alias("i"))
    values = own.where("col > 0").select(*keys, "row", "col", F.trim(F.coalesce("text", F.lit(""))).alias("value"))
    found = values.join(heading.hint("shuffle_hash"), [*keys, "row"]).join(columns, [*keys, "col"])
    found = cut(found.select(*keys, "row", "col", "value", "cpd", "i", F.struct("title", "own", "i").alias("heading")), "values")
    named = parsed(found, "heading", "__f", row_field).select(*found.columns, "__f.*").drop("heading")
    repeats = F.count("*").over(Window.partitionBy(*keys, "col", "field")) > 1
    field = F.when(repeats, suffixed(F.col("field"), F.concat(F.lit("[column "), F.col("i").cast("string"), F.lit("]")))).otherwise(F.col("field"))
    review = F.col("count").isNull() & (~is_value(F.col("value")) | F.lower("field").contains("unknown"))
    return named.withColumn("field", field).select(*keys, "col", "row", "cpd", "field", "count", "value", review.alias("needs_review"))


def unsupported_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, text, reason): columns of such tables whose heading declares no compound; they stay evidence and give no rows."""
    own, headers = under_headers(cells, keys)
    placed = own.where((F.col("row") < FIRST_ROWS) & (F.col("col") > 0)).join(headers.withColumnRenamed("header_row", "row").hint("shuffle_hash"), [*keys, "row"])
    return placed.where(declared_compound(F.col("text")).isNull()).select(*keys, "col", "text", F.lit("unsupported_header").alias("reason"))
