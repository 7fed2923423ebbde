"""Writers: long and sheet-like exports, JSON lines, structure files, idempotent publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import formula_safe, tab_line


def long_rows(table: DataFrame, keys: list[str], activities: str) -> DataFrame:
    """A row for each activity, and one with an empty activity for records without any; text is formula-safe."""
    rows = table.select(*keys, F.explode_outer(activities).alias("__a")).select(*keys, "__a.*")
    return rows.select(*[formula_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def selected(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the given ids; an id without a row fails the job."""
    wanted = ids.select(key).distinct().withColumn("__w", F.lit(True))
    joined = wanted.join(table.withColumn("__t", F.lit(True)), key, "left")
    return joined.where(F.when(F.col("__t").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string")))).otherwise(F.lit(True))).drop("__w", "__t").select(*table.columns)


def json_document(table: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group, document): each group's rows as one JSON object with its header and ordered items."""
    items = [c for c in table.columns if c not in group]
    rest = [c for c in items if c not in order]
    rows = table.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("items"))
    return rows.select(*group, F.to_json(F.struct(*group, F.size("items").alias("n_items"), "items")).alias("document"))


def sheet(catalogue: DataFrame, activities: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The catalogue with each record's activities joined in source order by " | "."""
    parts = activities.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), " | ").alias(value))
    return catalogue.join(parts, key, "left")


def activity_sheet(table: DataFrame, keys: list[str], field: str, value: str, sources: str) -> DataFrame:
    """A row for each source whose cells hold the value of the field, or one without a source."""
    own = F.filter(sources, lambda s: F.exists(s["cells"], lambda c: (c["field"] == F.col(field)) & (c["value"] == F.col(value))))
    return table.select(*keys, field, value, F.explode_outer(own).alias("source"))


def structure_file(table: DataFrame, block: str, tags: list[str]) -> DataFrame:
    """Each record as one text of a structure-data file; records without a block are left out."""
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"> <{t}>\n"), F.coalesce(F.col(t).cast("string"), F.lit("")), F.lit("\n")) for t in tags])
    return table.where(F.col(block).isNotNull()).select(F.concat(F.col(block), F.lit("\n"), lines, F.lit("\n$$$$")).alias("value"))


def tsv(table: DataFrame) -> DataFrame:
    return table.select(tab_line(*[F.col(c) for c in table.columns]).alias("value"))


def publish(table: DataFrame, path: str, partitions: list[str] | None = None, form: str = "parquet") -> None:
    """Write through Spark's committer: readers see the old files or all new ones.

    With partitions, only those that the table holds are replaced.
    """
    writer = table.write.mode("overwrite").format(form)
    if partitions:
        writer = writer.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic")
    if form == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)
