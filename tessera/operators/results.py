"""A table of results as a user asks for it: search, filters, order, one page, and the choices of each column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facets import facet_of, facet_totals
from .filters import Filter, checked, matching, search
from .ranking import page_of, workbook_order


@dataclass(frozen=True)
class Request:
    """What is asked of a table; everything is checked before anything is read."""

    text: str = ""
    filters: tuple[Filter, ...] = ()
    sort: str | None = None
    descending: bool = False
    page: int = 1
    size: int = 50


@dataclass(frozen=True)
class Results:
    """A table of array cells by column, with the columns that the text search reads and what orders equal rows.

    columns: name to kind (text, identifier or band), as for filters. Start from ``eligibility.in_scope`` for a study's view.
    """

    table: DataFrame
    columns: dict[str, str]
    ordinal: tuple[str, ...]
    searched: tuple[str, ...] = ()
    bands: dict = field(default_factory=dict)

    def matching(self, request: Request) -> DataFrame:
        """All rows that the request's text and filters let through."""
        if request.sort is not None and request.sort not in self.columns:
            raise ValueError(f"unknown column {request.sort!r}")
        rows = matching(self.table, list(request.filters), self.columns, self.bands)
        return search(rows, request.text, list(self.searched)) if request.text else rows

    def page(self, request: Request) -> DataFrame:
        """One page, in the order of a column's first value (missing last, also where that one is blank) or of the table: a top-k plan."""
        rows = self.matching(request)
        if request.sort is None:
            return page_of(rows, [F.col(c) for c in self.ordinal], request.page, request.size)
        first = F.get(F.col(request.sort), F.lit(0))
        keyed, order = workbook_order(rows.withColumn("__sort", first), "__sort", list(self.ordinal), request.descending)
        return page_of(keyed, order, request.page, request.size).select(*self.table.columns)

    def total(self, request: Request) -> DataFrame:
        return self.matching(request).agg(F.count("*").alias("total"))

    def choices(self, request: Request, column: str, page: int = 1, size: int = 200, within: str = "") -> DataFrame:
        """The values of a column under all other filters and the text, counted by row; within searches the values."""
        rows = search(self.table, request.text, list(self.searched)) if request.text else self.table
        return facet_of(rows, column, checked(list(request.filters), self.columns), self.columns, page, size, within)

    def choice_totals(self, request: Request, column: str, within: str = "") -> DataFrame:
        """How many values ``choices`` has over all pages, rows without one, and all rows under the other filters."""
        rows = search(self.table, request.text, list(self.searched)) if request.text else self.table
        filters = [f for f in checked(list(request.filters), self.columns) if f.column != column]
        return facet_totals(matching(rows, filters, self.columns), column, within)
