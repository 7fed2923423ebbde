"""Overlays, upserts, tombstones and latest-per-key rows.

Overlay tables are sparse and keyed like their base. Joins carry no broadcast hints: the
optimizer broadcasts what its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def latest_value(rows: DataFrame, keys: list[str], value: Column, order: Column, name: str) -> DataFrame:
    """The value with the greatest order of each key; combines before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def overlaid(base: DataFrame, overlays: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The base with each overlay's row as a struct of the overlay's name (null where it has none)."""
    for name, rows in overlays.items():
        side = rows.select(*keys, F.struct(*[c for c in rows.columns if c not in keys]).alias(name))
        base = base.join(side, keys, "left")
    return base


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """For each key the row with the greatest revision of either table; changes win ties."""
    both = base.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return latest(both, keys, F.desc(revision), F.desc("__new")).drop("__new")


def live(rows: DataFrame, tombstones: DataFrame, keys: list[str], parents: DataFrame | None = None, parent_keys: list[str] | None = None) -> DataFrame:
    """Rows that are not deleted, and whose parents are not."""
    rows = rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")
    return rows if parents is None else rows.join(parents.select(*parent_keys).distinct(), parent_keys, "left_anti")


def replaced_snapshot(base: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """The base with every partition that the snapshot holds replaced by it."""
    return base.join(snapshot.select(*keys).distinct(), keys, "left_anti").unionByName(snapshot)


def corrected(base: DataFrame, corrections: DataFrame, keys: list[str], fields: list[str], basis: Column) -> DataFrame:
    """Edited fields apply only while the basis fingerprint still matches; otherwise the row is marked stale.

    corrections: keys, basis, and the edited fields (null: not edited).
    """
    side = corrections.select(*keys, F.col("basis").alias("__basis"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = base.withColumn("__now", basis).join(side, keys, "left")
    fresh = F.coalesce(F.col("__basis") == F.col("__now"), F.lit(False))
    out = joined.withColumn("correction", F.when(F.col("__basis").isNull(), "none").when(fresh, "applied").otherwise("stale"))
    for f in fields:
        out = out.withColumn(f, F.when(fresh, F.coalesce(f"__{f}", f)).otherwise(F.col(f)))
    return out.drop("__basis", "__now", *[f"__{f}" for f in fields])


def effective(manual: Column, computed: Column, model: Column, key: str) -> Column:
    """A property: a manual entry wins even if it is null, then a computed value, then the model's."""
    return F.when(F.map_contains_key(manual, F.lit(key)), manual[key]).otherwise(F.coalesce(computed[key], model[key]))


def preferred(wanted: DataFrame, found: DataFrame, key: str, alternatives: Column, tag: str) -> DataFrame:
    """wanted left join found on the key where found's tag is among the alternatives; the earliest alternative wins."""
    rows = wanted.join(found, key, "left").withColumn("__rank", F.array_position(alternatives, F.col(tag)))
    rows = rows.withColumn(tag, F.when(F.col("__rank") > 0, F.col(tag)))
    return latest(rows, [key], F.when(F.col("__rank") > 0, F.col("__rank")).otherwise(F.lit(1 << 30)), F.col(tag)).drop("__rank")
