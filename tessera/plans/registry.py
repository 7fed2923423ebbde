"""The register of queries, and the expressions that derive evidence from the driver's tables.

Expressions are SQL that Spark and DuckDB read alike, so both sides see the same source strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NUMBER = "cast(cast(l_quantity as bigint) as string)"
#: A source string of a line: missing, censored, a range or an exact number.
RAW = f"case when l_discount = 0 then 'ND' when l_quantity > 45 then '>45' when l_quantity < 3 then '<3' when l_discount = cast(0.01 as double) then concat('[', {NUMBER}, ',', cast(cast(l_quantity as bigint) + 5 as string), ']') else {NUMBER} end"
#: A table cell: blank, censored, a letter, plus signs or an exact number.
CELL = f"case when l_tax = 0 then '' when l_quantity > 45 then '>45' when l_linenumber = 7 then 'A' when l_linenumber = 6 then '+++' else {NUMBER} end"
#: A printed identifier of a part.
PRINTED = "case when p_size % 4 = 0 then concat('Compound ', cast(p_partkey as string)) when p_size % 4 = 1 then concat('Cpd-', cast(p_partkey as string), 'a') when p_size % 4 = 2 then concat('I-', cast(p_size as string), '-', cast(p_partkey as string)) else cast(p_partkey as string) end"


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observed(spark: SparkSession, folder: str, raw: str = RAW) -> DataFrame:
    """(subject, flag, status, ordinal parts, raw): one observation for each line."""
    return read(spark, folder, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_orderkey", "l_linenumber", "l_quantity", F.expr(raw).alias("raw"))


OBSERVED = f"select l_partkey as subject, l_returnflag as flag, l_linestatus as status, l_orderkey, l_linenumber, l_quantity, {RAW} as raw from lineitem"
