"""Stages of the corpus pipeline against plain versions, on planted rows."""

import random

import corpus_pipeline
from tessera.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", None if t is None else len(t)) for i, t in rows], SCHEMA)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def first_of_each(rows):
    sets = [shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    best = {}
    for k, (i, _) in enumerate(rows):
        place = (i is None, i or 0, k)
        best[root[k]] = min(best.get(root[k], place), place)
    return sorted((rows[p[2]] for p in best.values()), key=str)


def near_rows():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(1, 160))]
        for _ in range(rng.randint(1, 4)):
            own = list(text)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    common = " ".join(rng.choice(words) for _ in range(30))
    rows += [common + " " + " ".join(rng.choice(words) for _ in range(k % 12)) for k in range(20)]
    rng.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


def test_near_copies_are_those_of_brute_force(spark):
    rows = near_rows()
    assert kept(corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), "")) == first_of_each(rows)


def test_near_copies_without_or_with_one_id(spark):
    text = " ".join(f"v{k}" for k in range(40))
    rows = [(None, "alone one two three four five"), (None, text), (3, text), (3, text), (None, None), (7, "other words here"), (7, "more words there")]
    found = corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), "")
    assert kept(found) == sorted([(None, rows[0][1]), (3, text), (None, None), rows[5], rows[6]], key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs_of(spark, []), "").count() == 0


def test_lines_of_rows_without_or_with_one_id(spark):
    line, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, line + "\nalpha"), (None, line + "\nbeta"), (4, other + "\ngamma"), (4, other + "\ngamma"), (4, other + "\ndelta")]
    found = [r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs_of(spark, rows), "").collect()]
    assert sum(line in t for t in found) == 1 and sum(other in t for t in found) == 1


def test_passages_and_scores_of_rows_without_or_with_one_id(spark, tmp_path):
    passage = " ".join(f"q{k}" for k in range(20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, passage), (None, "clean words of one row"), (5, passage), (5, "clean words of another row")]
    assert kept(corpus_pipeline.drop_benchmark_passages(spark, docs_of(spark, rows), str(tmp_path))) == sorted([rows[1], rows[3]], key=str)

    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "###", "$$$", "!!!", "|"]) for _ in range(60))
    rows = [(k, good() if k % 2 else bad()) for k in range(80)] + [(None, good()), (None, bad()), (901, good()), (901, bad())]
    spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.keep_quality(spark, docs_of(spark, rows), str(tmp_path))
    assert kept(found) == sorted((r for r in rows if "###" not in r[1]), key=str)


def test_short_lines_go_when_repeated(spark):
    rows = [(1, "All rights reserved.\none two three"), (2, "All  rights reserved.\n\none two four"), (3, "one two three\nAll rights reserved."), (4, "x\nx")]
    found = corpus_pipeline.drop_repeated_lines(spark, docs_of(spark, rows), "")
    assert kept(found) == [rows[0], (2, "\none two four"), (4, "x")]


def test_long_lines_with_several_changed_words(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    lines = []
    for _ in range(15):
        line = [rng.choice(words) for _ in range(rng.randint(30, 170))]
        for _ in range(rng.randint(1, 4)):
            own = list(line)
            for _ in range(rng.randint(0, 4)):
                k = rng.choice([0, len(own) - 1, rng.randrange(len(own))])
                own[k : k + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            lines.append(" ".join(own))
    rng.shuffle(lines)
    want, seen = [], []
    for k, line in enumerate(lines):
        a, w = shingles(line), line.split()
        one = lambda v: line_dedup.within_edits(w, v)
        if any(one(t.split()) or 5 * len(a & shingles(t)) >= 4 * len(a | shingles(t)) for t in seen):
            want.append(k)
        seen.append(line)
    found = corpus_pipeline.drop_repeated_lines(spark, docs_of(spark, list(enumerate(lines))), "")
    assert kept(found) == sorted(((k, t) for k, t in enumerate(lines) if k not in want), key=str)
    assert any(not any(line_dedup.within_edits(lines[k].split(), t.split()) for t in lines[:k]) for k in want)
