"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, content_sort, decontam, line_dedup, middle, packing, pii, quality, quality_rules, repair, simhash, token_prefix, toxicity

SCHEMA = "doc_id long, text string, score double, lang string, fp string, n_words string"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ROWS = [(1, None), (2, ""), (3, "   \n \t "), (4, LONG), (5, "one two three four five six seven"), (6, "one two three four five six seven"), (6, "one two three four five six seven"), (7, "ünï 漢字 🙂 <|endoftext|>")]
LABELS = [(1, 1, 0), (2, 0, 1), (4, None, None), (5, 1, 0), (6, 0, 1)]
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, -1.0, "xx", "zz", "q") for i, t in rows], SCHEMA)


def labels_of(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def turns_of(docs):
    """Each document as a turn of a conversation, with columns that clash."""
    return docs.select((F.col("doc_id") % 3).alias("conv_id"), F.when(F.col("doc_id") != 2, F.col("doc_id")).alias("turn"), F.when(F.col("doc_id") != 1, "user").alias("role"), "text", F.lit("x").alias("place"), F.lit(1).alias("p"), F.lit("y").alias("audit"))


def items_of(spark, rows=((1, "one two three four five six seven"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels_of(s))),
    "packing": lambda s, d: packing.pack(packing.pieces(d, WORD)),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
    "decontamination": lambda s, d: decontam.benchmark_matches(d, items_of(s)),
    "clean_documents": lambda s, d: decontam.clean_documents(d, items_of(s)),
    "quality_rules": lambda s, d: quality_rules.judged(d, labels_of(s)),
    "pii": lambda s, d: pii.find(d, pii.fit(pii.labelled_table(s).limit(0))),
    "quality": lambda s, d: quality.quality_scores(d, labels_of(s)),
    "tokens": lambda s, d: token_prefix.prefix_token_table(d, BYTE),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "content_sort": lambda s, d: content_sort.exact_groups(d),
    "middle": lambda s, d: middle.fill_in_middle(d),
    "chats": lambda s, d: chat.format_chats(turns_of(d)),
    "repair": lambda s, d: repair.audited(turns_of(d), repair.damaged(turns_of(d))),
}
PER_ROW = ("content_sort", "middle", "toxicity", "quality_rules", "pii", "quality", "tokens", "simhash")


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, name):
    found = OPERATORS[name](spark, docs_of(spark, ROWS)).collect()
    if name in PER_ROW:
        assert sorted(r["doc_id"] for r in found) == [1, 2, 3, 4, 5, 6, 6, 7]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs_of(spark, [])).collect() == []


def test_values_on_hard_rows(spark):
    docs = docs_of(spark, ROWS)
    tokens = {r["doc_id"]: r for r in OPERATORS["tokens"](spark, docs).collect()}
    assert (tokens[1]["n_tokens"], tokens[2]["n_tokens"], tokens[2]["n_bytes"]) == (0, 0, 0)
    near = {r["doc_id"]: r for r in OPERATORS["simhash"](spark, docs).collect()}
    assert near[1]["fp"] == near[3]["fp"] == 0 and near[3]["component_id"] == 1
    assert near[6]["component_id"] == 5
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 7]
    leaks = {r["doc_id"]: r["similarity"] for r in decontam.benchmark_matches(docs, items_of(spark)).collect()}
    assert leaks == {5: 1.0, 6: 1.0}
    rules = {r["doc_id"]: r for r in OPERATORS["quality_rules"](spark, docs).collect()}
    assert rules[1]["n_words"] == 0 and rules[1]["base_failed"] and not rules[1]["kept"]
    assert not any(r["base"] or r["added"] for r in OPERATORS["pii"](spark, docs).collect())


def test_no_labels(spark):
    docs = docs_of(spark, ROWS)
    none = labels_of(spark, [])
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert quality_rules.learn(quality_rules.counts(docs), none) == []


def test_chats(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, "bot", "yo"), (2, 1, "user", "hi"), (3, 1, "user", "hi"), (3, 2, "bot", "yo"), (4, None, None, None), (None, 1, "user", "hi"), (5, 1, "user", "hi"), (5, 2, "bot", "no"), (5, 3, "user", "ok")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chat", F.lit("clash"))
    found = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.format_chats(log).collect()}
    assert {k: v[0] for k, v in found.items()} == {1: 2, 4: 1, 5: 3}
    assert found[1][1] == "<|user|>\nhi\n<|end|>\n<|bot|>\nyo\n<|end|>\n"
    assert chat.format_chats(log.limit(0)).collect() == []


def test_chats_with_ties_repeats_and_long_texts(spark):
    """The order of the input's rows does not matter; repeated rows count; a long text comes back whole."""
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "assistant", "c"), (1, None, "system", "s"), (1, 1, "user", "a"), (2, 1, "user", LONG), (3, 1, "user", LONG), (3, 2, "user", LONG + "!")]
    schema = "conv_id long, turn long, role string, text string"
    one = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    two = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.format_chats(spark.createDataFrame(rows[::-1], schema)).collect()}
    assert one == two and set(one) == {1, 3} and one[1][0] == 5 and one[1][1].count("\na\n") == 2
    assert one[1][1].startswith("<|system|>\ns\n<|end|>\n<|assistant|>\nc\n")
    assert one[3][1] == f"<|user|>\n{LONG}\n<|end|>\n<|user|>\n{LONG}!\n<|end|>\n"


def test_packing_round_trip(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "Gamma,", "x1", "été"]) for _ in range(rng.choice([0, 1, 5, 40, 300, 900])))) for k in range(80)]
    packed = packing.pack(packing.pieces(docs_of(spark, rows), WORD, window=64, with_ids=True), window=64).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    ids, filled = {}, {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["start"])):
        assert len(ids.setdefault(r["doc_id"], [])) == r["start"]
        ids[r["doc_id"]] += r["ids"]
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert ids == {k: library.encode(t, add_special_tokens=False).ids + [1] for k, t in rows}
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
