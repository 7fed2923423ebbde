"""Exact copies by one sort of the content; of equal texts the row with the largest id stays.

Texts are equal when they are identical after lower-casing A-Z alone.

1. Sampled splitters deal the normalised texts out by range: by their first bytes, then by a hash of
   the whole, then by id. So a splitter has a bounded size, and a group of copies of any size falls
   into as many ranges as it needs.
2. Each range is sorted (Spark's external sort) by the same key and the whole text, largest id first:
   equal texts are neighbours, and the row that stays comes first.
3. A worker streams through a range and compares each text with its neighbour in full. A run of
   equal texts is counted by its ids; of the texts it holds only the last one.
4. Runs that reach over the edge of a range are joined by comparing the texts at the two edges in
   full. Only the edge rows are read for that; the rows inside a range are finished without another shuffle.

Cases: a null text is empty, so null and empty texts are equal; rows with one id count by
themselves, and of equal rows exactly one stays; a null id loses to any other, and a group
without ids has a null keep_id; very long texts are compared whole; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

#: First bytes of a text by which ranges are cut.
PREFIX = 48
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SORTED = "part long, run long, edge string, doc_id long, keep_id long, group_size long, place long, text_sha256 string, text binary"


def normalised(text: Column) -> Column:
    """text with A-Z in lower case; texts of ASCII alone take the shorter way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted range, each with what its run of equal texts holds within the range.

    The last run stays open until the range ends; ``edge`` marks rows of the first ('f') and the last ('l')
    run, of which one row each carries the text.
    """
    part, run, text, sha, edge = TaskContext.get().partitionId(), -1, None, None, "f"
    ids: list[int | None] = []

    def closed(mark: str | None) -> pa.RecordBatch:
        n = len(ids)
        texts = [text if mark else None] + [None] * (n - 1)
        whole = [[part] * n, [run] * n, [mark] * n, ids, [ids[0]] * n, [n] * n, range(n), [sha] * n, texts]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(whole, kinds)], [c.split()[0] for c in SORTED.split(", ")])

    for whole in batches:
        for batch in slices(whole):
            done = []
            for i, t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if run < 0 or t != text:
                    if run >= 0:
                        done.append(closed(edge or None))
                        edge = ""
                    run, text, sha, ids = run + 1, t, s, []
                ids.append(i)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if run >= 0:
        yield closed(edge + "l")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text"))
    key = [F.substring("text", 1, PREFIX), F.xxhash64("text"), F.col("doc_id").desc_nulls_last()]
    dealt = rows.repartitionByRange(*key).sortWithinPartitions(*key[:2], "text", key[2])
    found = cut(dealt.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256")).mapInArrow(neighbours, SORTED), "sorted")
    return joined_runs(found)


def joined_runs(found: DataFrame) -> DataFrame:
    """The rows with runs that go on over the edges of ranges counted as one.

    Ranges have two edges each, whatever the number of rows, and the joins compare only what stands there.
    """
    edges = found.where("text is not null")
    first = edges.where("edge like 'f%'").select("part", F.col("text").alias("first_text"))
    last = edges.where("edge like '%l'").select("part", F.col("run").alias("last_run"), F.col("text").alias("last_text"))
    in_order = Window.orderBy("part")  # a row for each range
    ranges = last.select("part", "last_run").withColumn("before", F.lag("part").over(in_order))
    goes_on = ranges.join(first, "part").join(last.select(F.col("part").alias("before"), "last_text"), "before").where("first_text = last_text").select("part", F.lit(True).alias("goes_on"))
    ranges = ranges.select("part", "last_run").join(goes_on, "part", "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    # a chain of runs begins at the last run of a range that holds several, or whose only run does not go on from the one before
    begins = F.when(~F.col("goes_on") | (F.col("last_run") > 0), F.struct("part", F.col("last_run").alias("run")))
    head = F.last(begins, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    chained = ranges.withColumn("head", head).where("goes_on").select("part", F.lit(0).cast("long").alias("run"), "head")
    own = edges.select("part", "run", "keep_id", "group_size")
    members = own.join(chained, ["part", "run"], "left").withColumn("first", F.col("head").isNull()).withColumn("head", F.coalesce("head", F.struct("part", "run")))
    totals = members.groupBy("head").agg(F.sum("group_size").alias("all_rows"), F.max("keep_id").alias("all_keep"), F.count("*").alias("runs")).where("runs > 1")
    several = members.join(totals, "head").select("part", "run", "first", "all_rows", "all_keep")
    rows = found.drop("text", "edge").join(several, ["part", "run"], "left")
    return rows.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_rows", "group_size").alias("group_size"),
        ((F.col("place") == 0) & F.coalesce("first", F.lit(True))).alias("kept"),
        "text_sha256",
    )
