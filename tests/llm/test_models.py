"""Learned operators against plain versions: gradients by differences, densities by their formulas, recall on other forms."""

import itertools
import os
import pickle
import random
import subprocess
import sys
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, line_dedup, pii, quality, quality_rules, simhash, similar, toxicity


def noisy_or_loss(theta, label, plain, owner, sentence, word):
    z = theta[-1] + np.bincount(sentence, theta[word], len(owner))
    none = np.log1p(np.exp(theta[-2])) + plain * np.log1p(np.exp(theta[-1])) + np.bincount(owner, np.log1p(np.exp(z)), len(label))
    return np.where(label > 0, -np.log(1 - np.exp(-none)), none).mean()


def test_noisy_or_gradient():
    rng = np.random.default_rng(3)
    label = np.array([1.0, 0.0, 1.0, 0.0])
    plain, owner = np.array([2.0, 3.0, 0.0, 1.0]), np.array([0, 0, 1, 2, 2, 3])
    sentence, word = np.array([0, 0, 1, 2, 3, 4, 5]), np.array([0, 1, 1, 2, 0, 2, 1])
    theta = np.append(rng.uniform(0.2, 2, 3), [-2.0, -1.5])
    found = toxicity.gradient(theta, label, plain, owner, sentence, word)
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        rise = noisy_or_loss(theta + step, label, plain, owner, sentence, word) - noisy_or_loss(theta - step, label, plain, owner, sentence, word)
        assert abs(found[k] - rise / 2e-6) < 1e-6


def test_vocabulary_scores(spark):
    rng = random.Random(4)
    rows = [(" ".join({rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(3)} | ({"rude"} if k % 3 == 0 and k % 7 else set())), int(k % 3 == 0)) for k in range(90)]
    rows = list({t: (t + f" x{k}", y) for k, (t, y) in enumerate(rows)}.values()) + [(f"rude w{k}", 1) for k in range(20)] + [(f"calm w{k}", 0) for k in range(20)]
    found = toxicity.vocabulary(spark.createDataFrame(rows, "text string, label int"), 50, 5)
    counts, ones = {}, {}
    for t, y in rows:
        for f in {f for w in set(t.split()) for f in toxicity.features(w)}:
            counts[f] = counts.get(f, 0) + 1
            ones[f] = ones.get(f, 0) + y
    rate = sum(y for _, y in rows) / len(rows)
    z = {f: (ones[f] - n * rate) / np.sqrt(n * rate * (1 - rate)) for f, n in counts.items() if n >= 5}
    assert found == sorted((f for f in z if z[f] > 3), key=lambda f: (-z[f], f)) and "rude" in found


def test_discriminant_is_that_of_the_formulas(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bb", "Ccc", "d#", "5", "!"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    import zlib

    taught = [k for k in range(80) if zlib.crc32(str(k).encode()) % 4 != 2]
    x = np.array([quality.statistics(t) for t in texts])
    groups = [x[[k for k in taught if k % 2 == y]] for y in (0, 1)]
    covs = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, covs)) / len(taught)
    density = []
    for g, c in zip(groups, covs):
        c = 0.98 * (0.9 * c + 0.1 * pooled) + 0.02 * np.diag(np.diag(pooled)) + 1e-9 * np.eye(len(c)) * max(1e-9, np.trace(pooled))
        m = x - g.mean(axis=0)
        density.append(np.log(len(g) / len(taught)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (m * np.linalg.solve(c, m.T).T).sum(axis=1))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))
    found = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    assert all(abs(found[k] - want[k]) < 1e-6 for k in range(80))


def test_field_gradient():
    """The field's expectations against all tag sequences of short sentences."""
    rng = np.random.default_rng(6)
    n_traits, tags = 5, len(pii.TAGS)
    lists = [rng.choice(n_traits, 2, replace=False).tolist() for _ in range(5)]
    truth, ends = np.array([0, 1, 2, 0, 3]), np.array([3, 5])
    weights = [rng.normal(size=(n_traits, tags)) * 0.3 for _ in range(3)] + [rng.normal(size=(tags, tags)) * 0.3]
    grads = pii.gradient(weights, np.array(lists), truth, ends)

    def likelihood(w):
        total = 0.0
        for a, z in zip([0, 3], ends):
            score = np.array([w[0][lists[k]].sum(0) + (w[1][lists[k - 1]].sum(0) if k > a else 0) + (w[2][lists[k + 1]].sum(0) if k + 1 < z else 0) for k in range(a, z)])
            moves = w[3] + pii.allowed()
            value = lambda path: sum(score[k, t] for k, t in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:]))  # noqa: E731, B023
            begins = [k for k, t in enumerate(pii.TAGS) if t[0] != "I"]
            every = [value(p) for p in itertools.product(range(tags), repeat=z - a) if p[0] in begins]
            top = max(every)
            total += value(truth[a:z]) - top - np.log(np.exp(np.array(every) - top).sum())
        return total

    for which in range(4):
        for cell in [(0, 0), (1, 1), (2, 2), (3, 0)]:
            up, down = [w.copy() for w in weights], [w.copy() for w in weights]
            up[which][cell] += 1e-5
            down[which][cell] -= 1e-5
            assert abs(grads[which][cell] - (likelihood(up) - likelihood(down)) / 2e-5) < 1e-4, (which, cell)


def test_field_finds_forms_that_it_was_not_taught(spark):
    rng = random.Random(8)
    field = pii.fit(pii.labelled_table(spark))
    words = lambda n: " ".join("".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    key = lambda n, letters="0123456789abcdef": "".join(rng.choice(letters) for _ in range(n))
    made = [lambda: f'api_key = "{key(36)}"', lambda: f"password: {key(24, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')}", lambda: f"TOKEN = {key(40).upper()}", lambda: f"secret={key(48)}", lambda: f"phone {key(3, '23456789')}.{key(3, '0123456789')}.{key(4, '0123456789')}", lambda: f"tel ({key(3, '23456789')}) {key(3, '0123456789')}-{key(4, '0123456789')}"]
    planted = [f"{words(8)} {rng.choice(made)()} {words(6)}" for _ in range(200)]
    clean = [words(30).capitalize() + ". Licensed under CC BY-NC 4.0. Version 2.0, 12 of 1999, page 45." for _ in range(200)]
    found = pii.added_spans(field, planted + clean, [[] for _ in planted + clean])
    assert sum(map(bool, found[:200])) >= 160 and sum(map(bool, found[200:])) <= 4


def test_every_token_is_decoded(spark):
    """Long lines and many lines give what one decoding of each line alone gives."""
    field = pii.fit(pii.labelled_table(spark).where("sentence < 200"), rounds=40)
    rng = random.Random(9)
    sentences = [" ".join(t for t, _ in s) for s in pii.written_sentences(300, 5)]
    text = "\n".join(rng.choice(["", " "]).join(rng.sample(sentences, 3)) for _ in range(400))
    base = [[]]
    whole, at, alone = pii.added_spans(field, [text], base)[0], 0, []
    for line in text.split("\n"):
        alone += [(a + at, b + at, k) for a, b, k in pii.added_spans(field, [line], [[]])[0]]
        at += len(line) + 1
    assert whole == alone and len(whole) > 200


def test_blocks_of_a_window_give_its_best_tags():
    rng = np.random.default_rng(5)
    moves = rng.normal(size=(len(pii.TAGS), len(pii.TAGS))) + pii.allowed()
    for n in (1, 2, 3, 8, 9, 10, 33, 100, 257):
        scores = rng.normal(size=(n, len(pii.TAGS))) * 2
        assert (pii.viterbi_by_blocks(n, lambda a, b: scores[a:b], moves, 8, 3) == pii.viterbi(scores, np.array([n]), moves)).all()


def test_one_very_long_line(spark, monkeypatch):
    """A million tokens without a line break: the tags of the usual decoding, in bounded time and memory."""
    field = pii.fit(pii.labelled_table(spark).where("sentence < 200"), rounds=40)
    sentences = [" ".join(t for t, _ in s) for s in pii.written_sentences(300, 5)]
    rng = random.Random(3)
    text = " ".join(rng.choice(sentences) for _ in range(2000))
    blocks = pii.added_spans(field, [text], [[]])
    monkeypatch.setattr(pii, "LONG_LINE", 1 << 40)
    assert blocks == pii.added_spans(field, [text], [[]]) and len(blocks[0]) > 500
    monkeypatch.undo()
    code = (
        "import sys, time, resource; sys.path.insert(0, sys.argv[1]); import pickle, random; from tessera.llm import pii\n"
        "field = pickle.load(open(sys.argv[2], 'rb')); rng = random.Random(1)\n"
        "text = ' '.join(rng.choice(['ab', 'cde', 'key', '1234567890', 'x']) for _ in range(1_000_000))\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; began = time.process_time(); pii.added_spans(field, [text], [[]])\n"
        "print(time.process_time() - began, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)"
    )
    with tempfile.NamedTemporaryFile() as f:
        pickle.dump(field, f)
        f.flush()
        env = os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
        took, grown = map(float, subprocess.run([sys.executable, "-c", code, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), f.name], capture_output=True, text=True, check=True, env=env).stdout.split()[-2:])
    assert took < 20 and grown < 200, (took, grown)


def test_decision_list_against_a_plain_one(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["word", "term", "list"] if k % 2 else ["b#", "$$", "&x"]) for _ in range(rng.randint(60, 90))) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, labels).collect() if not r["base_failed"]}
    assert all(v == bool(k % 2) for k, v in kept.items())


def plain_list(rows, cuts, max_rules, max_conditions, purity, least_gain):
    """Sequential covering by plain loops. rows: (shares by name, label, aside); gives rules of (share, above, threshold)."""
    holds = lambda shares, c: shares[c[0]] > c[2] if c[1] else shares[c[0]] <= c[2]
    whole = lambda shares, rule: all(holds(shares, c) for c in rule)
    count = lambda some: (sum(y == 0 for _, y, _ in some), sum(y == 1 for _, y, _ in some))
    rules = []
    for _ in range(max_rules):
        left = [r for r in rows if not any(whole(r[0], rule) for rule in rules)]
        grow, rule = [r for r in left if not r[2]], []
        while all(count(grow)) and len(rule) < max_conditions:
            zero, one = count(grow)
            best = (0.0, None)
            for share in quality_rules.SHARES:
                for t in cuts[share]:
                    for above in (False, True):
                        p, n = count([r for r in grow if holds(r[0], (share, above, t))])
                        gain = p * (np.log2(p / (p + n)) - np.log2(zero / (zero + one))) if p else 0.0
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (share, above, t))
            if best[1] is None or best[0] < least_gain:
                break
            rule.append(best[1])
            grow = [r for r in grow if holds(r[0], best[1])]
        if not rule:
            break
        tried = []
        for k in range(1, len(rule) + 1):
            p, n = count([r for r in left if r[2] and whole(r[0], rule[:k])])
            tried.append(((p - n) / max(1, p + n), -k, p / (p + n) if p + n else 0.0))
        _, k, pure = max(tried)
        if pure < purity:
            break
        rules.append(rule[:-k])
    return rules


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"max_rules": 3, "purity": 0.55, "least_gain": 2.0})])
def test_learned_list_is_the_plain_one(spark, seed, options):
    """Growing, pruning, order and ties: the same rules as plain sequential covering, on noisy labels."""
    rng = random.Random(seed)
    texts = []
    for k in range(260):
        kinds = rng.choice([["word", "term", "list"], ["b#", "$$", "x"], ["LOUD!", "word"], ["12", "34", "term"]])
        texts.append("\n".join(" ".join(rng.choice(kinds) + str(rng.randrange(30)) * (rng.random() < 0.5) for _ in range(rng.randint(8, 30))) for _ in range(4)))
    labels = [(k, int(("#" in t or "LOUD" in t) == (rng.random() < 0.15))) for k, t in enumerate(texts)]
    rows = quality_rules.counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    taught = spark.createDataFrame(labels, "doc_id long, quality int")
    known = rows.join(taught, "doc_id").where(~quality_rules.base_failed() & ~quality_rules.held_out("doc_id"))
    shares = [F.expr(f"cast({e} as double)").alias(k) for k, e in quality_rules.SHARES.items()]
    plain = [({k: r[k] for k in quality_rules.SHARES}, r["quality"], r["aside"]) for r in known.select("quality", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("aside"), *shares).collect()]
    given = {"max_rules": 8, "max_conditions": 3, "purity": 0.8, "least_gain": 5.0} | options
    want = plain_list(plain, quality_rules.thresholds(known), **given)
    found = [[(c.share, c.above, c.threshold) for c in rule] for rule in quality_rules.learn(rows, taught, **options)]
    assert found == want and found


def test_edits_of_two_words(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(9)]
    lines = []
    for _ in range(50):
        own = [rng.choice(words) for _ in range(rng.randint(4, 9))]
        lines.append(own)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(own))
            own = own[:k] + [rng.choice(words)] * rng.randint(0, 1) + own[k + rng.randint(0, 1) :]
            lines.append(own)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for a, b in itertools.combinations(lines, 2):
        for most in (1, 2, 3):
            assert line_dedup.within_edits(a, b, most) == (distance(a, b) <= most)
    rng.shuffle(lines)
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string")
    found = {r["doc_id"] for r in line_dedup.dropped_lines(docs, edits=2).collect()}
    assert found == {k for k, x in enumerate(lines) if len(x) >= 5 and any(len(y) >= 5 and distance(x, y) <= 2 for y in lines[:k])}


def test_wide_fingerprints_find_what_is_similar(spark):
    rng = random.Random(12)
    words = [f"v{k}" for k in range(900)]
    texts = []
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(6, 200))]
        texts.append(" ".join(own))
        for _ in range(rng.randint(1, 4)):
            changed = list(own)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                changed[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(changed))
    rows = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "node long, text binary")
    root = {r["node"]: r["root"] for r in simhash.similar_documents(rows).collect()}
    sets = [set(similar.shingle_set(t.encode(), 5).tolist()) for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(near) > 60 and all(root[a] == root[b] for a, b in near)


def test_sets_of_unlike_sizes_do_not_link(spark):
    """Nodes of one fingerprint: only those whose sizes allow a similarity of 4/5 link, and all chains of these, over tiles of any number."""
    rng = random.Random(15)
    sizes = [1, 4, 5, 100, 125, 126, 157, 158, 198, 1000, 1250, 1251, 20_000] + [rng.randint(2000, 9000) for _ in range(40)]
    nodes = spark.createDataFrame([(k, [7, -7], n) for k, n in enumerate(sizes)], "node long, words array<long>, size int")
    fit = [(a, b) for a, b in itertools.combinations(range(len(sizes)), 2) if 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])]

    def groups(pairs):
        root = list(range(len(sizes)))
        for a, b in pairs:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return {tuple(k for k, r in enumerate(root) if r == own) for own in root}

    for tile in (4, 1000):
        assert groups((r["a"], r["b"]) for r in simhash.links(nodes, 36, 2, tile=tile).collect()) == groups(fit)


def test_decontamination_recall_by_similarity(spark):
    """Over the Spark path: items with edits inside, in bands of similarity, against brute force."""
    rng = random.Random(13)
    words = [f"k{k}" for k in range(3000)]
    items = {i: [rng.choice(words) for _ in range(rng.randint(12, 120))] for i in range(60)}
    docs = []
    for k in range(240):
        own = list(items[k % 60])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append([rng.choice(words) for _ in range(rng.randint(0, 60))] + own + [rng.choice(words) for _ in range(rng.randint(0, 60))])
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.benchmark_matches(spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    want = {}
    for k, d in enumerate(docs):
        own, text = [w.encode() for w in items[k % 60]], [w.encode() for w in d]
        best = max(decontam.similarity(text[s : s + len(own)], own, 5) for s in range(len(text) - len(own) + 1))
        if best >= 0.8:
            want[k, k % 60] = best
    bands = {0.8: [0, 0], 0.85: [0, 0], 0.9: [0, 0], 1.0: [0, 0]}
    for key, value in want.items():
        band = max(b for b in bands if b <= value)
        bands[band][0] += key in found
        bands[band][1] += 1
    assert len(want) > 100 and all(hit >= 0.9 * of for hit, of in bands.values()), bands
    assert all(abs(found[k] - want[k]) < 1e-9 for k in found if k in want) and all(k in want for k in found)
