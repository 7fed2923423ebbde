"""Merging repeated records without averaging them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_rows(rows: DataFrame, document: str, compound: str, page: str, ordinal: str, values: str) -> DataFrame:
    """Fold a compound's rows with disjoint fields into one; overlapping fields stay separate rows.

    By page (unknown last), then input order, a row joins the first earlier row that shares no field
    with it, else it becomes a new row. The fold runs over the ordered rows of one compound.
    """
    own = F.struct(F.col(page).isNull().alias("unknown"), F.col(page).alias("page"), F.col(ordinal).cast("long").alias("ordinal"), F.map_entries(values).alias("fields"))
    grouped = rows.groupBy(document, compound).agg(F.array_sort(F.collect_list(own)).alias("rows"))

    def add(done: Column, row: Column) -> Column:
        names = lambda fields: F.transform(fields, lambda f: f["key"])
        free = F.transform(done, lambda x: ~F.arrays_overlap(names(x["fields"]), names(row["fields"])))
        home = F.array_position(free, True)
        new = F.struct(row["ordinal"].alias("ordinal"), row["fields"].alias("fields"))
        joined = F.transform(done, lambda x, i: F.when(i + 1 == home, F.struct(x["ordinal"].alias("ordinal"), F.concat(x["fields"], row["fields"]).alias("fields"))).otherwise(x))
        return F.when(home == 0, F.concat(done, F.array(new))).otherwise(joined)

    none = F.array().cast("array<struct<ordinal:bigint,fields:array<struct<key:string,value:string>>>>")
    folded = F.explode(F.aggregate("rows", none, add)).alias("row")
    return grouped.select(document, compound, folded).select(document, compound, F.col("row.ordinal").alias(ordinal), F.array_sort("row.fields").alias(values))


def identical_merge(rows: DataFrame, label: str, chemistry: str, properties: list[str]) -> DataFrame:
    """By label: rows of one chemistry merge (a property stays only if all its values agree); others conflict."""
    agree = [F.when(F.count_distinct(p) == 1, F.min(p)).alias(p) for p in properties]
    conflicts = [(F.count_distinct(p) > 1).alias(f"{p}_conflict") for p in properties]
    merged = rows.groupBy(label).agg(F.count("*").alias("n_rows"), F.count_distinct(chemistry).alias("n_chemistry"), *agree, *conflicts)
    return merged.withColumn("status", F.when(F.col("n_chemistry") > 1, "identifier_conflict").otherwise("merged"))


def consensus(rows: DataFrame, keys: list[str], value: str, mixed: str) -> DataFrame:
    """The one value of a group, or a name for disagreement."""
    return rows.groupBy(*keys).agg(F.when(F.count_distinct(value) == 1, F.min(value)).otherwise(mixed).alias(value))
