"""Very long runs of one kind of character, through every operator and stage: right results in bounded time."""

import random
import time

import corpus_pipeline
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from tessera.llm import chat, content_sort, decontam, line_dedup, middle, packing, pii, quality, quality_rules, repair, simhash, token_prefix, toxicity

SIZE = 1_000_000
RUNS = {
    "symbols": "#" * SIZE,
    "spaces": " " * SIZE,
    "letters and an at sign": "a" * (SIZE // 2) + "@" + "b" * (SIZE // 2),
    "at signs": "@a" * (SIZE // 2),
    "digits and a dot": "1" * (SIZE // 2) + "." + "2" * (SIZE // 2),
    "zeros": "0" * 5000 + ".1.1.1",
    "dots": "1." * (SIZE // 2),
    "plus signs": "+1 " * (SIZE // 3),
    "line breaks": "\n" * (SIZE // 4),
    "one letter words": "a " * (SIZE // 4),
    "sentence ends": "." * SIZE,
}
MODEL = toxicity.Model({"idiot": 9.0}, -6.0, 0.01)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "x", len(t)) for k, t in enumerate(texts)], SCHEMA)


def labels_of(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")


def items_of(spark):
    return spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")


def turns_of(docs):
    return docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text")


def folder_of(spark):
    """A folder with the labels and items above."""
    path = f"{spark.conf.get('spark.checkpoint.dir')}/hard-{time.time_ns()}"
    labels_of(spark).write.parquet(f"{path}/labels.parquet")
    items_of(spark).write.parquet(f"{path}/benchmark.parquet")
    return path


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score(d, MODEL),
    "packing": lambda s, d: packing.pack(packing.pieces(d, public_tokenizers.path("word_bpe_49k.json"))).select("doc_id").distinct(),
    "line_dedup": lambda s, d: d.select("doc_id").join(line_dedup.dropped_lines(d, exact_words=1, shingle=5), "doc_id", "left"),
    "decontamination": lambda s, d: d.select("doc_id").join(decontam.benchmark_matches(d, items_of(s)), "doc_id", "left"),
    "quality_rules": lambda s, d: quality_rules.judged(d, labels_of(s)),
    "pii": lambda s, d: pii.find(d, pii.fit(pii.labelled_table(s).where("sentence < 60"), rounds=10)),
    "quality": lambda s, d: quality.quality_scores(d, labels_of(s)),
    "tokens": lambda s, d: token_prefix.prefix_token_table(d, public_tokenizers.path("byte_bpe_50k.json"), budget=1024),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "near_copies_stage": lambda s, d: corpus_pipeline.drop_near_copies(s, d, ""),
    "content_sort": lambda s, d: content_sort.exact_groups(d),
    "middle": lambda s, d: middle.fill_in_middle(d),
    "chats": lambda s, d: chat.format_chats(turns_of(d)).select(F.col("conv_id").alias("doc_id")),
    "repair": lambda s, d: repair.audited(turns_of(d), repair.damaged(turns_of(d))).select(F.col("conv_id").alias("doc_id")),
    "quality_stage": lambda s, d: corpus_pipeline.keep_quality(s, d, folder_of(s)),
    "passages_stage": lambda s, d: corpus_pipeline.drop_benchmark_passages(s, d, folder_of(s)),
    "packing_stage": lambda s, d: corpus_pipeline.pack_sequences(s, d, ""),
    "lines_stage": lambda s, d: corpus_pipeline.drop_repeated_lines(s, d, ""),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_runs(spark, name):
    began = time.time()
    found = OPERATORS[name](spark, docs_of(spark, RUNS.values())).collect()
    assert time.time() - began < 10 * len(RUNS)
    if not name.endswith("stage"):
        assert sorted({r["doc_id"] for r in found}) == list(range(len(RUNS)))


def test_python_parts_are_linear():
    field = pii.Field({}, *(None,) * 3, None)
    for name, text in RUNS.items():
        began = time.time()
        pii.base_spans(text)
        pii.added_spans(field, [text], [[]])
        MODEL.document(text)
        pii.traits(text)
        assert time.time() - began < 10, name


def plain_spans(text):
    """The patterns as they are written, kind by kind."""
    found = []
    for k, kind in enumerate(pii.KINDS):
        for m in (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)[k].finditer(text):
            digits = [c for c in m.group() if c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for k, n in enumerate(map(int, reversed(digits))))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            found.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def test_base_patterns_on_random_texts():
    rng = random.Random(21)
    parts = ["a", "b.c", "@", "x@y.z", ".", "..", "1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111", "+", "+1", " ", "-", "(", ")", "0" * 9, "é", "\n", "_", "%", "a@b", "00001", "+44 20 7946 0958"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)
