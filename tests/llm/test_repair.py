"""Content sort, fill-in-the-middle and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from tessera.llm import content_sort, middle, queries, repair

LONG = "Word and more. " * 20_000


# ---- exact copies by content sort


def plain_groups(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    groups, made = {}, []
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        made += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(made, key=str)


CLASHING = "doc_id long, text string, part string, run long, edge string, keep_id string, place long"


def grouped(spark, rows, parts=5):
    df = spark.createDataFrame([(i, t, "p", 1, "f", "k", 0) for i, t in rows], CLASHING).repartition(parts)
    return sorted((tuple(r) for r in content_sort.exact_groups(df).collect()), key=str)


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as they are cut, so that small tables have several, and groups reach over their edges."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("n", [0, 1, 4, 60, 400])
def test_exact_groups(spark, many_ranges, n):
    rng = random.Random(n)
    texts = ["", None, "A", "a", "É", "é", "aB" * 30, "ab" * 30, "x" * 200_000, "ab" * 30 + "c", "K", "ß"] + [f"t{k}" for k in range(30)]
    rows = [(rng.choice([None, *range(n)]), rng.choice(texts[:8] if rng.random() < 0.6 else texts)) for _ in range(n)]
    assert grouped(spark, rows) == plain_groups(rows)


def test_a_group_over_all_ranges(spark, many_ranges):
    rows = [(k, "Same" if k % 3 else f"other {k % 5}") for k in range(2000)]
    assert grouped(spark, rows) == plain_groups(rows)
    rows = [(k, "SAME" if k % 2 else "same") for k in range(500)] + [(7, "same"), (499, "same"), (499, "same")]
    assert grouped(spark, rows) == plain_groups(rows)


def test_the_sorted_ranges_hold_neighbours(spark, many_ranges):
    """A group lies in several ranges, and none of these holds more than its share of it."""
    rows = spark.createDataFrame([(k, "same") for k in range(4000)], "doc_id long, text string")
    key = [F.substring("text", 1, 4), F.xxhash64("text"), F.col("doc_id").desc_nulls_last()]
    parts = rows.repartitionByRange(*key).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 2500


# ---- fill-in-the-middle


def plain_middle(doc_id, text):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_ranked_bits():
    rng = random.Random(3)
    for width in [1, 2, 3, 7, 64, 65, 1000, 4097]:
        bits = rng.getrandbits(width) | 1 << rng.randrange(width)
        places = [k for k in range(width) if bits >> k & 1]
        assert [middle.ranked(bits, width, k + 1) for k in range(len(places))] == places


def test_middle_against_a_plain_version(spark):
    rng = random.Random(4)
    parts = ["a", "Zz", "é", "ª", "1", " ", "\n", "_", "<", "<P", ">", "S>", "M", "漢字", "🙂", "\x00", "K", "ſ", "@", "[", "`", "{", "\udc80".encode("utf-8", "replace").decode()]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(3000)]
    rows += [(None, "no id"), (1, None), (2, ""), (3, LONG), (3, LONG), (-5, "below <S> zero"), (10**15, "x" * 300_000), (11, "." * 300_001), (12, "é" * 100_000 + "a")]
    for i, t in rows:
        assert middle.transformed(i, t or "") == plain_middle(i, t or "")
    docs = spark.createDataFrame([(i, t, 5, "form") for i, t in rows], "doc_id long, text string, n int, form string")
    made = middle.fill_in_middle(docs)
    back = made.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["back"]) for r in back) == sorted((i is None, i or 0, t or "") for i, t in rows)
    forms = {r["form"] for r in back}
    assert forms == {"plain", "psm", "spm"}
    assert all((r["prefix_chars"] is None) == (r["form"] == "plain") for r in back)
    assert middle.fill_in_middle(docs.limit(0)).collect() == []


# ---- conversation repair


def plain_damage(rows):
    kept = []
    word = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        if draw:
            kept += [(conv, turn, role, text)] * (2 if draw == 3 else 1)
    return kept


def plain_repair(turns):
    """turns (turn, role, text) in order: counts, cost, audit and repaired lines by search over all edits."""
    seen, faults = set(), []
    for _, role, text in turns:
        rest = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @cache
    def best(k, state, inserts):
        """(cost, audit, lines) of the cheapest way on, of these the ASCII-least."""
        options = [(0, "", ())] if k == len(turns) and state in (0, 3) else []

        def go(cost, edit, line, k2, state2, inserts2=0):
            c, a, ls = best(k2, state2, inserts2)
            options.append((cost + c, edit + a, (() if line is None else (line,)) + ls))

        if inserts < 3:
            for name in ("user", "assistant"):
                if (state, name[0]) in step:
                    go(5, "I", f"{name}:", k, step[state, name[0]], inserts + 1)
        if k < len(turns):
            _, role, text = turns[k]
            go(2, "D", None, k + 1, state)
            if faults[k] not in ("blank", "duplicate"):
                more = 5 if faults[k] == "truncated" else 0
                if (state, role[:1]) in step:
                    go(more, "K", f"{role}:{text}", k + 1, step[state, role[:1]])
                for name in ("user", "assistant"):
                    if (state, name[0]) in step:
                        go(1 + more, "R", f"{name}:{text}", k + 1, step[state, name[0]])
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    cost, audit, lines = best(0, 0, 0)
    known = [t for t, _, _ in turns if t is not None]
    pairs = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_audit(rows, damaged):
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged:
        by[conv].append((turn, role, text))
    order = lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).hexdigest())
    return sorted(((k, *plain_repair(sorted(v, key=order))) for k, v in by.items()), key=str)


def random_log(rng, conversations, most):
    texts = ["Hello there.", "no end", "", " \n\t", "Why?!", "really.  \n", "…", "漢字。", "ok!", None, "a.b c"]
    rows = []
    for conv in range(conversations):
        turns = list(range(rng.randint(0, most)))
        for t in turns:
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            role = rng.choice([None, "", "system", "tool", "ünd", "unknown", "User"]) if rng.random() < 0.15 else role
            text = rng.choice(texts) if rng.random() < 0.5 else f"turn {rng.randint(0, 99)} of many."
            rows.append((None if conv == 3 else conv, None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 2]), role, text))
    return rows


def audits(spark, rows):
    log = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, pos int")
    return sorted((tuple(r) for r in repair.audited(log, repair.damaged(log)).collect()), key=str)


@pytest.mark.parametrize("chunk", [4096, 3, 1])
def test_repair_against_a_search(spark, monkeypatch, chunk):
    """Also with chunks so short that nearly every conversation is chained of several."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = random_log(random.Random(6), 120, 9) + [(900, 1, "user", "Same."), (900, 1, "user", "Same."), (900, 1, "user", "Same.")] + [(901, None, None, None)]
    assert audits(spark, rows) == plain_audit(rows, plain_damage(rows))


def test_costs_and_traces_against_a_search():
    """The tensors alone, over every short list of roles and faults."""
    import numpy as np

    texts = ["", "End.", "open"]
    for n in range(4):
        cases = list(itertools.product([("system", 0), ("user", 1), ("assistant", 2), ("tool", 3)], texts, repeat=n)) if n < 3 else []
        codes, wanted = [], []
        for case in cases or random.Random(1).sample(list(itertools.product(range(4), texts, range(4), texts, range(4), texts, range(4), texts)), 1500):
            flat = list(case)
            turns = []
            for k in range(0, len(flat), 2):
                role = flat[k] if isinstance(flat[k], tuple) else [("system", 0), ("user", 1), ("assistant", 2), ("tool", 3)][flat[k]]
                turns.append((k, role[0], flat[k + 1] and f"{k} {flat[k + 1]}", role[1]))
            codes.append([c + (repair.GOES if not t else 0 if t.endswith(".") else repair.TRUNCATED) for _, _, t, c in turns])
            wanted.append(plain_repair([t[:3] for t in turns])[5:7])
        for index, block in repair.buckets(codes):
            best = repair.costs(block, np.repeat(repair.DONE[None], len(index), 0)[:, None, :])[:, :, 0]
            found, _ = repair.traced(block, best, np.zeros(len(index), int), np.ones(len(index), bool))
            for j, k in enumerate(index):
                assert (int(best[0, j, 0]), found[:, j][found[:, j] > 0].tobytes().decode()) == wanted[k]


def test_a_long_conversation_is_several_chunks(spark):
    rng = random.Random(8)
    roles = ["user", "assistant", "user", "system"]
    rows = [(1, t, rng.choice(roles[:2] if rng.random() < 0.9 else roles), f"{t} said{rng.choice(['.', '.', ''])}") for t in range(12_000)] + [(2, 0, "user", LONG), (2, 1, "assistant", LONG)]
    found = audits(spark, rows)
    repair_chunk, repair.CHUNK = repair.CHUNK, 1 << 20
    try:
        assert found == audits(spark, rows)
    finally:
        repair.CHUNK = repair_chunk


def test_empty_log(spark):
    assert audits(spark, []) == []


def test_queries_give_their_columns(spark):
    folder = "/root/testdata/sf0.001"
    assert queries.QUERIES["op11_exact_dedup"](spark, folder).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert queries.QUERIES["op12_fill_in_middle"](spark, folder).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert queries.QUERIES["op13_conversation_repair"](spark, folder).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
