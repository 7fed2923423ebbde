"""Held-out accuracy of the learned operators on the driver's small tables."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, quality_rules, toxicity
from tessera.llm.common import held_out

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def read(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def judged(spark, scores, label, at):
    rows = scores.join(read(spark, "labels"), "doc_id").where(held_out()).select((F.col("score") >= at).cast("int").alias("p"), F.col(label).alias("y")).collect()
    right = sum(r["p"] == r["y"] for r in rows) / len(rows)
    return right, sum(r["p"] == 1 for r in rows if r["y"] == 1) / max(1, sum(r["y"] for r in rows))


def test_quality(spark):
    right, recall = judged(spark, quality.quality_scores(read(spark, "documents"), read(spark, "labels")), "quality", 0.7)
    assert right > 0.93 and recall > 0.93


def test_toxicity(spark):
    docs = read(spark, "documents")
    right, _ = judged(spark, toxicity.score(docs, toxicity.fit(docs, read(spark, "labels"))), "toxic", 0.3)
    assert right > 0.9


def test_rules_keep_the_clean(spark):
    rows = quality_rules.judged(read(spark, "documents"), read(spark, "labels")).join(read(spark, "labels"), "doc_id").where(~F.col("base_failed"))
    counts = {(r["quality"], r["kept"]): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, True), 0) > 0.97 * (counts.get((1, True), 0) + counts.get((1, False), 0))
    assert counts.get((0, False), 0) > 0.7 * (counts.get((0, True), 0) + counts.get((0, False), 0))


def test_pipeline(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns and 0.5 * before < docs.count() <= before, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.count()
