"""Conservation and coverage checks: each returns the rows that break a rule, so no rows means that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def set_differences(observed: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, side): extra where only observed, missing where only known."""
    extra = observed.select(key).distinct().join(known.select(key), key, "left_anti").withColumn("side", F.lit("extra"))
    missing = known.select(key).distinct().join(observed.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    return extra.unionByName(missing)


def sequence_differences(a: DataFrame, b: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Places where two ordered lists differ, or where one has ended."""
    left, right = (df.select(*keys, place, F.col(value).alias(n)) for df, n in ((a, "left"), (b, "right")))
    return left.join(right, [*keys, place], "full").where(~F.col("left").eqNullSafe(F.col("right")))


def mapping_conflicts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(side, value, n): values that map to more than one partner in either direction."""
    count = lambda x, y, name: rows.groupBy(F.col(x).cast("string").alias("value")).agg(F.count_distinct(y).alias("n")).where("n > 1").select(F.lit(name).alias("side"), "value", "n")
    return count(a, b, a).unionByName(count(b, a, b))


def inventory_gaps(declared: DataFrame, observed: DataFrame, keys: list[str], declared_n: str) -> DataFrame:
    """Keys whose declared count differs from the rows observed."""
    counts = observed.groupBy(*keys).agg(F.count("*").alias("n_observed"))
    both = declared.select(*keys, F.col(declared_n).alias("n_declared")).join(counts, keys, "full").na.fill(0, ["n_declared", "n_observed"])
    return both.where("n_declared <> n_observed")


def unreconciled(groups: DataFrame, totals: DataFrame, keys: list[str], parts: str, whole: str) -> DataFrame:
    """Groups whose parts don't add up to their total."""
    sums = groups.groupBy(*keys).agg(F.sum(parts).alias("n_parts"))
    both = sums.join(totals.select(*keys, F.col(whole).alias("n_whole")), keys, "full").na.fill(0, ["n_parts", "n_whole"])
    return both.where("n_parts <> n_whole")


def uncovered(wanted: DataFrame, regions: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Pages without a region record (unresolved), or with an unresolved one."""
    joined = wanted.select(*keys).distinct().join(regions.select(*keys, F.col(status).alias("status")), keys, "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("unresolved/no_supported_activity_table"))).where(F.col("status").startswith("unresolved"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique, with their rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def quality_counters(rows: DataFrame, label: str, status: str) -> DataFrame:
    """Totals of a result table: rows, distinct labels, confirmed and to review."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(label).alias("n_labels"), F.count_if(F.col(status) == "confirmed").alias("n_confirmed"), F.count_if(F.col(status) != "confirmed").alias("n_review"))


def kept_by_budget(entries: DataFrame, owner: str, size: str, newest: str, identity: str, most_bytes: int, most_entries: int) -> DataFrame:
    """Cache entries that stay: newest first while bytes and entries are within the budget."""
    order = Window.partitionBy(owner).orderBy(F.desc(newest), identity).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("__b", F.sum(size).over(order)).withColumn("__n", F.count("*").over(order)).where((F.col("__b") <= most_bytes) & (F.col("__n") <= most_entries)).drop("__b", "__n")


def enforced(rows: DataFrame, message: str) -> None:
    """Raise if a check returned rows; only one row is read."""
    first = rows.take(1)
    if first:
        raise AssertionError(f"{message}: {first[0].asDict()}")
