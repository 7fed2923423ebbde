"""Operators against plain versions on small random data."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tessera.llm import decontam, line_dedup, packing, pii, quality_rules, simhash, token_prefix, toxicity
from tessera.llm.components import components


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_prefix_counts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter, rng = Tokenizer.from_file(path), token_prefix.PrefixCounter(path), random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "'", "é", "漢字", "12", " x", "!!", "<|endoftext|>", "<|end", "\x1c", "🙂", "ation", "\r\n", "́"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        steps, n = counter.texts([text])[0]
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert np.cumsum(np.frombuffer(steps, np.int8), dtype=int).tolist() == want, repr(text)
        assert n == (want[-1] if want else 0)


def test_prefix_questions(spark):
    from pyspark.sql import functions as F

    table = token_prefix.prefix_token_table(docs_of(spark, ["hello world, again and again"]), public_tokenizers.path("byte_bpe_50k.json"))
    row = table.select(token_prefix.tokens_at(F.col("steps"), F.lit(5)).alias("at"), token_prefix.truncate_to(F.col("steps"), 2).alias("cut"), token_prefix.tokens_at(F.col("steps"), F.lit(99)).alias("beyond")).first()
    assert (row["at"], row["cut"], row["beyond"]) == (1, 11, None)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 6000 + k) for k in range(80)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[root(a)] = root(b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(found) == nodes
    for a, b in itertools.combinations(sorted(nodes), 2):
        assert (found[a] == found[b]) == (root(a) == root(b))


def test_tiles_keep_every_connection(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set()
    for _ in range(250):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        prints.add(x - (1 << 64) if x >> 63 else x)
    nodes = spark.createDataFrame([(x, [x], 0) for x in prints], "node long, words array<long>, group long")
    found = {r["node"]: r["root"] for r in components(simhash.links(nodes, 4, tile=16)).collect()}
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
    parent = {x: x for x in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if near(a, b):
            parent[root(a)] = root(b)
    for a, b in itertools.combinations(prints, 2):
        assert (found.get(a, a) == found.get(b, b)) == (root(a) == root(b))


def test_fingerprint_definition():
    text = "The quick BROWN fox jumps over the lazy dog äÄ"
    words = [w for w in re.sub("[A-Z]", lambda m: m[0].lower(), text).split(" ")]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode(), 4, 42) & (1 << 64) - 1 == want
    assert simhash.fingerprint(b" \n", 4, 42) == 0


@pytest.mark.parametrize("least", [5, 1])
def test_line_dedup(spark, least):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(6)]
    lines = [[rng.choice(vocabulary) for _ in range(rng.randint(2, 8))] for _ in range(60)]
    for _ in range(60):
        own = list(rng.choice(lines))
        k = rng.randrange(len(own))
        own[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        lines.append(own)
    rng.shuffle(lines)
    texts = ["\n".join(" ".join(x) for x in lines[k : k + 4]) for k in range(0, len(lines), 4)]
    found = {r["doc_id"]: r["dropped"] for r in line_dedup.dropped_lines(docs_of(spark, texts), exact_words=least).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    seen, want = [], {}
    for d, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            words = line.split()
            if len(words) >= least:
                if words in seen or len(words) >= 5 and any(distance(words, x) <= 1 for x in seen if len(x) >= 5):
                    want.setdefault(d, []).append(k)
                seen.append(words)
    assert found == want


def test_decontamination():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    for _ in range(30):
        items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 5, 8, 20, 50])))) for i in range(8)]
        words = []
        for _ in range(3):
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
            own = rng.choice(items)[1].split()
            if rng.random() < 0.6:
                own[rng.choice([0, -1])] = "zz"
            words += own
        text, want = decontam.words_of(" ".join(words)), {}
        for i, t in items:
            w = t.encode().split()
            n, size = min(len(w), len(text)), min(5, len(w))
            for s in range(len(text) - n + 1):
                alike = decontam.similarity(text[s : s + n], w, size)
                if alike >= 0.8 and alike > want.get(i, (0,))[0]:
                    want[i] = (alike, s, n)
        found = {i: (a, s, n) for i, s, n, a in decontam.Index(items, 5, 22).scan(" ".join(words), 0.8)}
        assert found == want


def test_word_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder, rng = Tokenizer.from_file(path), packing.WordEncoder(path), random.Random(6)
    assert encoder.by_words
    parts = ["a", "The", " ", "  ", "\n", "\t", "'", "'s", "'S", "'re", "'LL", "''s", "'r", "12", "!!", ".", "é", "É", "ß", "ÿ", "×", "÷", "H̱", "\u0301", "\x1c", "\x85", "\xa0", "\u3000", "漢字", "🙂", "Σ", "İ", "\u212a", "²", "ª", "<|endoftext|>", "<|ENDOFTEXT|>", "<|end", "\x00", "</w>", "ation"]
    for _ in range(1500):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 5))]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts], repr(texts)


def test_words_are_sent_as_parts(monkeypatch):
    encoder, whole, parts = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), [], []
    monkeypatch.setattr(encoder, "encoded", lambda words, f=encoder.encoded: whole.extend(words) or f(words))
    encoder.ids(["Über über, (ÜBER) 漢字 — über's Maß."])
    assert sorted(whole) == ["—", "漢字"]
    monkeypatch.setattr(encoder, "encoded_parts", lambda words, f=encoder.encoded_parts: parts.extend(words) or f(words))
    encoder.ids(["über) (maß, über", "Maße"])
    assert [p.decode() for p in parts] == ["maße"]


def test_subset_sums():
    rng = random.Random(7)
    for _ in range(60):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 40)
        ranges = [range(n + 1) for n in counts.values()]
        best = max(s for pick in itertools.product(*ranges) if (s := sum(a * b for a, b in zip(counts, pick))) <= room)
        chosen = packing.closest(counts, room)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())


def test_plan_is_whole():
    rng = random.Random(8)
    histogram = Counter(rng.randint(1, 64) for _ in range(900)) + Counter({64: 300, 33: 400})
    steps, filled, placed = packing.plan(histogram, 64), Counter(), Counter()
    for length, rank, per, times, first, offset in steps:
        assert rank == placed[length]
        placed[length] += per * times
        for k in range(times):
            assert filled[first + k] == offset
            filled[first + k] += per * length
    assert placed == histogram and max(filled.values()) <= 64


def test_rule_counts(spark):
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "c#", "D!", "e|"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["a  b\x0bc d \n\n a b c"]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    found = {r["doc_id"]: r for r in quality_rules.counts(docs_of(spark, texts)).collect()}
    for d, text in enumerate(texts):
        words = word.findall(text)
        triples, seen, repeated = Counter(zip(words, words[1:], words[2:])), set(), 0
        places = {k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}
        for line in text.split("\n"):
            if word.search(line):
                repeated += line in seen
                seen.add(line)
        r = found[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(places)), repr(text)


def test_base_patterns():
    text = "mail a.b@c.example.com, 10.0.0.256 1.2.3.4, 4111 1111 1111 1111, +1 (212) 555-0100"
    assert [(k, text[a:b]) for a, b, k in pii.base_spans(text)] == [("email", "a.b@c.example.com"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100")]


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    sizes = [3, 1, 4]
    scores, ends = rng.normal(size=(8, len(pii.TAGS))), np.cumsum(sizes)
    moves = rng.normal(size=(len(pii.TAGS), len(pii.TAGS))) + pii.allowed()
    tags, at = pii.viterbi(scores, ends, moves), 0
    begins = [k for k, t in enumerate(pii.TAGS) if t[0] != "I"]
    for n in sizes:
        own = scores[at : at + n]
        value = lambda path: sum(own[k, t] for k, t in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        best = max((p for p in itertools.product(range(len(pii.TAGS)), repeat=n) if p[0] in begins), key=value)
        assert tuple(tags[at : at + n]) == best
        at += n


def test_field_learns(spark):
    field = pii.fit(pii.labelled_table(spark))
    texts = ['here token = "' + "3f9a" * 10 + '" ok', "call (212) 555-0100 now", "in 1999 we had 12 apples"]
    base = [pii.base_spans(t) for t in texts]
    found = [[(k, t[a:b]) for a, b, k in x] for t, x in zip(texts, pii.added_spans(field, texts, base))]
    assert found[0] == [("secret", "3f9a" * 10)] and found[2] == []


def test_sentences_are_found():
    model = toxicity.Model({"idiot": 9.0, "sc*": 8.0}, -6.0, 0.01)
    text = "A fine day. You idiot! Bye."
    score, marked = model.document(text)
    assert score > 0.9 and [text[a:b].strip() for a, b, _ in marked] == ["You idiot"]
    assert model.document("A fine day.")[0] < 0.05 and model.document("scum")[0] > 0.8
