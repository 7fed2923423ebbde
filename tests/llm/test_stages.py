"""Every pipeline stage on nulls in any column, empty and very long texts, repeated rows, ties, an empty table and clashing columns."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node string, score double, dropped array<int>, line string, words string, h1 long"
LONG = " ".join(f"long{k % 911}" for k in range(50_000))
SAME = "\n".join(" ".join(f"s{k}w{j}" for j in range(12)) for k in range(4))
BAD = "### $$$ BUY !!! | " * 30


def good(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60)) + "."


ROWS = [(None, None), (None, good(1)), (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, SAME), (5, SAME), (6, SAME), (7, BAD), (8, good(2)), (8, good(3))]
STAGES = dict(corpus_pipeline.STAGES)


def docs_of(spark, rows):
    filled = [(i, t, None, None, None if t is None else len(t), 7, "n", 0.5, [1], "l", "w", 3) for i, t in rows]
    return spark.createDataFrame(filled, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, k % 2, None) for k in range(100, 140)] + [(7, 0, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(SAME.split()[:12])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


TAKEN = ("__row", "__file", "__start", "__index", "_metadata", "__id", "__dropped", "row_number", "file", "index", "path", "start", "leak", "line_row", "line_dropped", "a.b", "a`b", "key", "root")


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_of_any_name(spark, folder, tmp_path, name):
    """A table read from files, with the names that stages might use for themselves: all columns come back as they were."""
    taught = [(k, good(k) if k % 2 else BAD + f"x{k} " * (k % 7)) for k in range(100, 140)]
    rows = [(i, t, None, None, None if t is None else len(t), *(f"{c} of {k}" for c in TAKEN)) for k, (i, t) in enumerate(ROWS + taught)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in TAKEN)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/taken")
    docs = spark.read.parquet(f"{tmp_path}/taken")
    found = STAGES[name](spark, docs, folder)
    assert found.columns == docs.columns
    plain = STAGES[name](spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), folder)
    assert kept(found) == kept(plain)
    own = {tuple(r)[5:] for r in docs.collect()}
    assert all(tuple(r)[5:] in own and len({v.split(" of ")[1] for v in tuple(r)[5:]}) == 1 for r in found.collect())


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, folder, name):
    found = STAGES[name](spark, docs_of(spark, []), folder)
    assert found.collect() == []
    assert name == "packing" or found.columns == docs_of(spark, []).columns


def test_quality(spark, folder):
    taught = [(k, good(k) if k % 2 else BAD + f"x{k} " * (k % 7)) for k in range(100, 140)]
    docs = docs_of(spark, ROWS + taught)
    found = STAGES["quality"](spark, docs, folder)
    assert found.columns == docs.columns
    rows = kept(found)
    assert (None, good(1)) in rows and (8, good(2)) in rows and (8, good(3)) in rows and not any(t and t.startswith(BAD[:40]) for _, t in rows)


def test_lines(spark, folder):
    docs = docs_of(spark, ROWS)
    found = STAGES["line_dedup"](spark, docs, folder)
    assert found.columns == docs.columns
    # of the three equal texts the first row's stays; texts without a word lose nothing
    assert kept(found) == sorted([r for r in ROWS if r[1] != SAME] + [(5, SAME)], key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found.collect())


def test_near_copies(spark, folder):
    docs = docs_of(spark, ROWS)
    found = STAGES["near_dedup"](spark, docs, folder)
    assert found.columns == docs.columns
    # null, empty and blank texts are equal: the smallest id stays
    assert kept(found) == sorted([(None, good(1)), (1, None), (4, LONG), (5, SAME), (7, BAD), (8, good(2)), (8, good(3))], key=str)


def test_passages(spark, folder):
    docs = docs_of(spark, ROWS)
    found = STAGES["decontamination"](spark, docs, folder)
    assert found.columns == docs.columns
    assert kept(found) == sorted([r for r in ROWS if r[1] != SAME], key=str)


def test_packing(spark, folder):
    found = STAGES["packing"](spark, docs_of(spark, ROWS), folder).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sum(r["length"] for r in found if r["doc_id"] == 5) == 2 * next(r["doc_tokens"] for r in found if r["doc_id"] == 5)
    assert [r["doc_tokens"] for r in found if r["doc_id"] == 1] == [1]  # the end token alone
    filled = {}
    for r in found:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 and sorted(o for o, _ in x) == [sum(n for p, n in x if p < o) for o in sorted(o for o, _ in x)] for x in filled.values())


def test_run_is_its_stages(spark, folder, tmp_path):
    """run() over a table gives what the stages give one after the other."""
    taught = [(k, good(k) if k % 2 else BAD + f"x{k} " * (k % 7)) for k in range(100, 140)]
    docs_of(spark, ROWS + taught).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/out{k}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
    pieces = lambda df: sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in df.select("doc_id", "start", F.col("ids_crc32")).collect())
    assert pieces(corpus_pipeline.run(spark, str(tmp_path))) == pieces(docs)
