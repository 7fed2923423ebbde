"""Readers: CSV with declared roles, JSON records, Parquet tables, incremental pages, molecule search."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.identifiers import NARROW, WIDE

#: Header names, without spaces, underscores and hyphens, that tell a column's role.
ROLES = {
    "identifier": {"id", "name", "compound", "compoundid", "cpd", "label"},
    "structure": {"smiles", "structure", "canonicalsmiles"},
    "metric": {"metric", "endpoint", "parameter"},
    "value": {"value", "result", "activity"},
    "unit": {"unit", "units"},
    "assay": {"assay", "assayname"},
    "target": {"target", "targetname"},
}


class SourceError(ValueError):
    """A source that is not what it should be; nothing is read past it or repaired."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The first bytes that tell an encoding, as Latin-1, and the separators that are looked for.
MARKS = {"ÿþ": "UTF-16LE", "þÿ": "UTF-16BE", "ï»¿": "UTF-8"}
SEPARATORS = (",", ";", "\t")


def csv_form(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, encoding) of a CSV, from its byte order mark and its first line; a comma and UTF-8 where nothing tells.

    The separator is the one that stands most often outside of quotes; an apostrophe is no quote.
    """
    first = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").csv(path).first()
    if first is None:
        raise SourceError("the file is empty")
    mark = next((m for m in MARKS if first[0].startswith(m)), "")
    encoding = MARKS.get(mark, "UTF-8")
    line = first[0][len(mark) :].replace("\x00", "")
    outside = "".join(line.split('"')[::2])
    best = max(SEPARATORS, key=outside.count)
    return (best if best in outside else ","), encoding


def csv(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None, most_columns: int = 256, multi_line: bool = True) -> DataFrame:
    """A CSV with a header of unique names, read as strings and with strict row width.

    A row that is too long or too short fails the job instead of being cut or padded, and so does a NUL. Separator and
    encoding are looked for unless given. Line breaks may stand inside quotes; without multi_line they may not, and one
    file is read by many tasks.
    """
    found = csv_form(spark, path) if separator is None or encoding is None else (separator, encoding)
    separator, encoding = separator or found[0], encoding or found[1]
    options = {"sep": separator, "quote": '"', "escape": '"', "encoding": encoding, "multiLine": multi_line, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "\x01", "emptyValue": ""}
    if encoding.startswith("UTF-16") and not multi_line:
        options["lineSep"] = "\n"
    header = spark.read.options(**options, header=False).csv(path).first()
    names = [(h or "").lstrip("\ufeff").rstrip("\r") for h in header or ()]
    if not 2 <= len(names) <= most_columns or len(set(names)) < len(names) or not all(n.strip() for n in names) or any(len(n) > 300 for n in names):
        raise SourceError("headers must be unique, not empty, and not too many")
    schema = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.options(**options, header=True, mode="FAILFAST", enforceSchema=True).schema(schema).csv(path)
    nul = F.raise_error(F.lit("a cell holds a NUL"))
    return rows.select(*[F.when(F.contains(F.col(f"`{n}`"), F.lit("\x00")), nul).otherwise(F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(n) for n in names])


def role_defaults(headers: list[str]) -> dict[str, str | None]:
    """The header of each role by its name alone; two candidates mean none."""
    plain = {h: re.sub(r"[\s_-]", "", unicodedata.normalize("NFKC", h)).casefold() for h in headers}
    found = {role: [h for h in headers if plain[h] in names] for role, names in ROLES.items()}
    return {role: hits[0] if len(hits) == 1 else None for role, hits in found.items()}


def default_roles(headers: Column) -> Column:
    """``role_defaults`` of an array of headers: a map from role to its one header; roles with none or several are absent."""
    plain = lambda h: F.lower(F.regexp_replace(F.translate(h, WIDE, NARROW), r"(?U)[\s_-]", ""))
    among = lambda names: F.filter(headers, lambda h: plain(h).isin(*sorted(names)))
    hits = [F.struct(F.lit(role).alias("role"), among(names).alias("found")) for role, names in ROLES.items()]
    one = F.filter(F.array(*hits), lambda x: F.size(x["found"]) == 1)
    return F.map_from_entries(F.transform(one, lambda x: F.struct(x["role"], F.get(x["found"], F.lit(0)).alias("header"))))


@dataclass(frozen=True)
class Mapping:
    """Which columns hold what: wide (one column a metric) or long (a metric column and a value column)."""

    identifier: str
    structure: str | None = None
    wide: tuple[str, ...] = ()
    metric: str | None = None
    value: str | None = None
    unit: str | None = None
    context: tuple[str, ...] = field(default_factory=tuple)


def observations(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """(identifier, structure, metric, unit, value, context columns): one row for each value that is there."""
    name = lambda c, alias: (F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(alias)
    base = [name(mapping.identifier, "identifier"), name(mapping.structure, "structure"), *[F.col(f"`{c}`") for c in mapping.context]]
    if mapping.wide:
        cells = F.explode(F.array(*[F.struct(F.lit(re.sub(r"\s*\([^()]*\)\s*$", "", c)).alias("metric"), F.lit(unit_in(c)).alias("unit"), F.col(f"`{c}`").alias("value")) for c in mapping.wide])).alias("cell")
        long = rows.select(*base, cells).select("identifier", "structure", *mapping.context, "cell.metric", "cell.unit", "cell.value")
    else:
        long = rows.select(*base, name(mapping.metric, "metric"), name(mapping.unit, "unit"), name(mapping.value, "value"))
    return long.where(F.trim(F.coalesce("value", F.lit(""))) != "")


def unit_in(header: str) -> str | None:
    m = re.search(r"\(([^()]+)\)\s*$", header)
    return m[1].strip() if m else None


def map_field(text: Column) -> Column:
    """A JSON object of strings as a map; null for anything else and for repeated keys."""
    keys = F.regexp_count(text, F.lit(r'"(?:[^"\\]|\\.)*"\s*:'))
    parsed = F.from_json(text, "map<string,string>")
    return F.when(F.cardinality(parsed) == keys, parsed)


def json_array(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Each element of a JSON array column as a row's struct named item; broken JSON gives none."""
    return rows.withColumn("item", F.explode(F.from_json(F.col(column), f"array<{schema}>"))).drop(column)


def expanded(rows: DataFrame, dictionary: DataFrame, reference: str) -> DataFrame:
    """Rows whose shared parts were replaced by references, with the parts of the dictionary (ref, part)."""
    return rows.join(dictionary.withColumnRenamed("ref", reference), reference, "left")


def new_pages(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that the cache lacks, or holds empty and has not tried twice."""
    done = cache.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.col("tries") >= 2)).select(*keys).distinct()
    return wanted.join(done, keys, "left_anti")


def searched(molecules: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any column; percent signs and underscores stand for themselves."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    return molecules.where(hit)


def fingerprint(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, fingerprint): one digest of each group's rows, whatever their order; repeats count.

    Rows are digested one by one; a group's digests meet in 4,096 parts by their first digits, and only the parts' digests
    meet in one row, so a group of any size is spread over tasks.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    digests = rows.select(*keys, row.alias("d")).groupBy(*keys, "d").agg(F.count("*").alias("n"))
    entry = F.concat_ws(":", "d", "n")
    parts = digests.groupBy(*keys, F.substring("d", 1, 3).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256).alias("d"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: F.concat_ws(":", x["p"], x["d"])), ","), 256)
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), whole.alias("fingerprint"))


def snapshot(rows: DataFrame, project: str, identity: str, running: DataFrame, corrections: DataFrame, reviews: DataFrame, fields: list[str], rules: str) -> tuple[DataFrame, DataFrame]:
    """The effective rows of projects for a study, and (project, n, revision): what they were made of.

    rows: project, identity, fields. corrections (identity, revision, fields) replace fields; reviews (identity, decision)
    take rejected records out. A project with a running job is refused. The revision changes with any row, correction
    or review, in any order of rows, and with the version of the rules.
    """
    busy = running.select(project).distinct().withColumn("__busy", F.lit(True))
    edits = corrections.select(identity, F.col("revision").alias("__revision"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = rows.select(project, identity, *fields).join(busy, project, "left").join(edits, identity, "left").join(reviews.select(identity, "decision"), identity, "left")
    joined = joined.where(F.when(F.col("__busy"), F.raise_error(F.lit("wait for the running job"))).otherwise(F.lit(True)))
    effective = [F.coalesce(f"__{f}", f).alias(f) for f in fields]
    sources = joined.select(project, identity, "__revision", "decision", *effective)
    made = fingerprint(sources.withColumn("rules", F.lit(rules)), [project], [identity, "__revision", "decision", "rules", *fields]).withColumnRenamed("fingerprint", "revision")
    return sources.where("decision is null or decision <> 'rejected'").select(project, identity, *fields), made


def within(rows: DataFrame, most: int, what: str = "rows") -> DataFrame:
    """The rows, refused if there are more than the bound; never silently fewer."""
    if rows.limit(most + 1).count() > most:
        raise SourceError(f"more than {most} {what}")
    return rows
