"""A study as its reader asks for it: members under a scope, contexts, one page of rows, regions, and the matrix of values.

Composed of the operators of scopes, statistics and orders; every method is a plan over the tables that it needs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import numbers as N

from .eligibility import in_scope
from .ranking import page_of, study_order
from .statistics import evidence_summary, histogram


@dataclass(frozen=True)
class Study:
    """members: molecule, label, strong, candidate_status, and properties. observations: molecule, context, raw. scaffolds and fragments as for ``in_scope``.

    grades: for a context the order of its grades, best first.
    """

    members: DataFrame
    observations: DataFrame
    scaffolds: DataFrame | None = None
    fragments: DataFrame | None = None
    grades: dict[str, list[str]] = field(default_factory=dict)

    def scope(self, **selection) -> DataFrame:
        """The members of a view (``in_scope``)."""
        return in_scope(self.members, scaffolds=self.scaffolds, fragments=self.fragments, **selection)

    def observed(self, **selection) -> DataFrame:
        return self.observations.join(self.scope(**selection).select("molecule").distinct(), "molecule", "left_semi")

    def contexts(self, **selection) -> DataFrame:
        """By context: rows, numbers, limits and bounds of the view's observations (``evidence_summary``)."""
        return evidence_summary(self.observed(**selection), ["context"], "raw")

    def distributions(self, **selection) -> DataFrame:
        """By context and bin: observations and molecules of the view (``histogram``); the bins span the view's own values."""
        return histogram(self.observed(**selection), ["context"], "molecule", "raw")

    def values(self, context: str) -> DataFrame:
        """(molecule, number, grade): what a context's readings of a molecule agree on; an interval, a conflict or a missing value is neither."""
        grades = self.grades.get(context)
        read = N.parsed(self.observations.where(F.col("context") == context).select("molecule", "raw").distinct(), "raw", "__v", lambda text: N.parse(text, grades))
        own = F.struct("__v.kind", "__v.low", "__v.high", "__v.lower_closed", "__v.upper_closed", "__v.grade")
        one = read.groupBy("molecule").agg(F.min(own).alias("a"), F.max(own).alias("b")).where(F.col("a").eqNullSafe(F.col("b")))
        known = F.array(*[F.lit(g) for g in grades or []]).cast("array<string>")
        rank = F.array_position(known, F.col("a.grade"))
        return one.select("molecule", F.when(F.col("a.kind") == "scalar", F.col("a.low")).alias("number"), F.when((F.col("a.kind") == "ordinal") & (rank > 0), rank).alias("grade"))

    def rows(self, sort: str = "label", descending: bool = False, page: int = 1, size: int = 50, **selection) -> DataFrame:
        """One page of a view's members, by label, property:<column> or context:<context>; unknown values come last in both directions."""
        kind, _, name = sort.partition(":")
        rows, value = self.scope(**selection), None
        if kind == "property":
            if name not in self.members.columns:
                raise ValueError(f"no such property: {name}")
            value = F.col(name)
        elif kind == "context":
            if self.observations.where(F.col("context") == name).isEmpty():
                raise ValueError(f"no such context: {name}")
            rows = rows.join(self.values(name), "molecule", "left")
            value = F.when(F.col("number").isNotNull() | F.col("grade").isNotNull(), F.struct("grade", "number"))
        elif sort != "label":
            raise ValueError(f"no such order: {sort}")
        keyed, order = study_order(rows, F.col("label"), "molecule", value, descending)
        return page_of(keyed, order, page, size).select(*self.members.columns)

    def regions(self) -> DataFrame:
        """(region, reference): fragments, molecules, and how many of these are strong."""
        joined = self.fragments.join(self.members.select("molecule", "strong"), "molecule", "left")
        strong = F.count_distinct(F.when(F.col("strong"), F.col("molecule")))
        return joined.groupBy("region", "reference").agg(F.count_distinct("fragment").alias("fragments"), F.count_distinct("molecule").alias("molecules"), strong.alias("strong"))

    def matrix(self, contexts: list[str], **selection) -> DataFrame:
        """A row for each member of the view and a column for each context: its distinct readings in order, joined by " | "; null where there are none."""
        cells = self.observed(**selection).where(F.col("context").isin(contexts)).select("molecule", "context", "raw").distinct()
        listed: Column = F.array_join(F.array_sort(F.collect_list("raw")), " | ")
        wide = cells.groupBy("molecule").pivot("context", contexts).agg(listed)
        return self.scope(**selection).select("molecule", "label").join(wide, "molecule", "left")
