"""The corpus pipeline: quality, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.
Rows count by themselves: those without an id, or with the id of another row, are told apart by a number that each stage
gives its rows (``numbered``) and drops again. Other columns, whatever their names, stay as they are.

Cases: a null text is empty; the quality classifier scores it like any other text; it loses no lines and stays null; all
texts without a word are equal, so of them the one with the smallest id stays; it holds no passage; it is packed as its
end token. Very long texts are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, line_dedup, packing, quality, simhash
from tessera.llm.common import columns_of, cut, free, numbered, release, scratch_tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.7 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    row = free(docs, "row_number")
    rows = numbered(docs, row)
    scored = quality.quality_scores(rows, labels, row_col=row).where("score >= 0.7").select(F.col("row").alias(row))
    return rows.join(scored.hint("shuffle_hash"), row, "left_semi").select(*columns_of(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that stand earlier, alike (whatever their length) within one word (of five or more),
    or with a similarity of five-word shingles of 0.8 or more; so do documents that lose every word."""
    row = free(docs, "row_number")
    kept = line_dedup.dedup_lines(numbered(docs, row), row_col=row, exact_words=1, shingle=5)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*columns_of(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of five-word shingles of 0.8 or more, the first stays.

    Fingerprints of 128 bits, compared tile by tile, find the pairs; the exact similarity decides.
    The first is the one with the smallest id (null last); rows without an id or with one id are rows apart.
    """
    row = free(docs, "row_number")
    rows = numbered(docs, row)
    texts = rows.select(F.col(row).alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = cut(simhash.similar_documents(texts).join(rows.select("doc_id", F.col(row).alias("node")), "node"), "groups")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    several = found.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", F.col("first.node").alias("stays"))
    gone = cut(found.join(several, "root").where("node <> stays").select(F.col("node").alias(row)), "near-copies")
    release(found)
    return rows.join(gone.hint("shuffle_hash"), row, "left_anti").select(*columns_of(docs))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go."""
    row = free(docs, "row_number")
    rows = numbered(docs, row)
    return decontam.clean_documents(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row).select(*columns_of(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, as pieces of sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Learned scores, word edits, fingerprints and token ids are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables that a stage needed meanwhile go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch_tables(spark):
            made = cut(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if k:
            release(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
