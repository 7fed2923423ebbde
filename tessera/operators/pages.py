"""Page classification, runs of pages, and positions in rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import PREFIXES, page_signals


def classified(pages: DataFrame, text: str) -> DataFrame:
    """Pages with the rules' signals; a page may be both activity and synthesis."""
    return pages.withColumns(page_signals(F.col(text)))


def extended(pages: DataFrame, document: str, page: str) -> DataFrame:
    """Synthesis pages with their continuations: a run of weak pages after a structure table, up to a stop.

    Blank pages don't end a run. Each page looks back to the last page that is neither blank nor weak:
    if that one opens a table, or the run never broke, the page belongs to it.
    """
    order = Window.partitionBy(document).orderBy(page)
    opens = F.col("synthesis") & F.col("table")
    passes = F.col("continues") & ~F.col("stops")
    anchor = F.when(F.col("blank"), None).when(opens, F.lit(1)).when(passes, None).otherwise(F.lit(0))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(anchor, ignorenulls=True).over(upto)
    return pages.withColumn("synthesis", F.col("synthesis") | (passes & ~F.col("blank") & (F.coalesce(carried, F.lit(0)) == 1)))


def located(pages: DataFrame, document: str, page: str, synthesis: str) -> DataFrame:
    """(document, page, evidence): the pages that show structures by themselves or continue a neighbour that does.

    pages: seed, barrier, table_like and chemical (``structures.structure_signals``) and whether a page is a synthesis page. From a
    page with evidence, that of its kind spreads both ways over adjoining pages until a barrier, a gap, or a page of another nature; between two
    such pages the later one's comes first. So a page belongs to the next evidence behind it if nothing between stops that kind, else to the last one before it:
    two carries between barriers, in place of a walk from page to page.
    """
    order = Window.partitionBy(document).orderBy(page)
    gap = F.col(page) != F.lag(page).over(order) + 1
    rows = pages.withColumns({"goes_table": ~F.col("barrier") & F.col("table_like"), "goes_caption": ~F.col("barrier") & F.col("chemical") & F.col(synthesis), "gap": F.coalesce(gap, F.lit(True))})
    run = F.sum(F.col("gap").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("stretch", run)
    back = Window.partitionBy(document, "stretch").orderBy(page).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ahead = Window.partitionBy(document, "stretch").orderBy(page).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the first page at or behind this one that is evidence or stops the kind
    mark = lambda kind: F.when(F.col("seed").isNotNull(), F.col("seed")).when(~F.col(f"goes_{kind}"), "stop")
    kinds = ("table", "caption")
    rows = rows.withColumns({f"behind_{k}": F.first(mark(k), ignorenulls=True).over(back) == k for k in kinds})
    later = F.coalesce(F.col("behind_table"), F.lit(False)) | F.coalesce(F.col("behind_caption"), F.lit(False))
    rows = rows.withColumn("taken", F.col("seed").isNull() & later)
    # what the later evidence has taken ends the earlier one's reach
    reach = lambda kind: F.when(F.col("seed").isNotNull(), F.col("seed")).when(~F.col(f"goes_{kind}") | F.col("taken"), "stop")
    rows = rows.withColumns({f"before_{k}": F.last(reach(k), ignorenulls=True).over(ahead) == k for k in kinds})
    is_ = lambda side, k: F.coalesce(F.col(f"{side}_{k}"), F.lit(False))
    found = (
        F.when(F.col("seed") == "table", "numbered_structure_table")
        .when(F.col("seed") == "caption", "numbered_synthesis_or_caption")
        .when(is_("behind", "table"), "structure_table_continuation")
        .when(is_("behind", "caption"), "synthesis_continuation")
        .when(is_("before", "table"), "structure_table_continuation")
        .when(is_("before", "caption"), "synthesis_continuation")
    )
    return rows.select(document, page, found.alias("evidence")).where("evidence is not null")


def dominant_prefix(pages: DataFrame, document: str, text: str) -> DataFrame:
    """(document, prefix, hits): the identifier prefix with the most matches; among equals the first listed."""
    counts = [F.sum(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p))).alias(f"__{k}") for k, (_, p) in enumerate(PREFIXES)]
    totals = pages.groupBy(document).agg(*counts)
    ranked = F.greatest(*[F.struct(F.col(f"__{k}").alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, _) in enumerate(PREFIXES)])
    return totals.withColumn("__b", ranked).select(document, F.when(F.col("__b.n") > 0, F.col("__b.name")).otherwise("Cpd-").alias("prefix"), F.col("__b.n").alias("hits"))


def runs(rows: DataFrame, keys: list[str], at: str, broken: Column, name: str = "run") -> DataFrame:
    """Number the runs of a sequence: a new one begins where broken holds."""
    order = Window.partitionBy(*keys).orderBy(at)
    first = F.row_number().over(order) == 1
    started = rows.withColumn("__s", F.when(first | F.coalesce(broken, F.lit(False)), 1).otherwise(0))
    return started.withColumn(name, F.sum("__s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__s")


def clustered(rows: DataFrame, keys: list[str], x: str, tolerance: float, name: str = "cluster") -> DataFrame:
    """Number clusters of positions: a gap over the tolerance begins a new one."""
    order = Window.partitionBy(*keys).orderBy(x)
    gap = F.when(F.col(x) - F.lag(x).over(order) > tolerance, 1).otherwise(0)
    return rows.withColumn("__g", gap).withColumn(name, 1 + F.sum("__g").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("__g")


def candidate_window(pages: DataFrame, document: str, page: str, back: int = 2, ahead: int = 2) -> DataFrame:
    """(document, first, last): from two pages before the first classified page to the page before the claims, or two after the last."""
    hit = F.col("activity") | F.col("synthesis")
    found = pages.groupBy(document).agg(F.min(F.when(hit, F.col(page))).alias("a"), F.max(F.when(hit, F.col(page))).alias("b"), F.min(page).alias("lo"), F.max(page).alias("hi"))
    stops = pages.where("stops").join(found, document).where(F.col(page) > F.col("a")).groupBy(document).agg(F.min(page).alias("stop"))
    joined = found.join(stops, document, "left")
    return joined.select(document, F.greatest(F.col("lo"), F.coalesce(F.col("a"), F.col("lo")) - back).alias("first"), F.least(F.col("hi"), F.coalesce(F.col("stop") - 1, F.col("b") + ahead, F.col("hi"))).alias("last"))
