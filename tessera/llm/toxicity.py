"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's chance is a logistic function of the learned weights of its distinct words; a
word's weight is the sum over itself and its beginnings of two to five letters, so inflected
and compound forms count. The document's chance is the leaky noisy-or 1 - (1 - leak) *
prod(1 - p): the leak takes up labels that no sentence explains, so that long texts don't
become suspect by length. Only documents carry labels; the gradient through the noisy-or
shares a label out among the sentences, so the model learns which ones offend and can point at
them. Weights are held at zero or above: a document cannot be washed clean by adding harmless
text.

Training takes a bounded sample of labelled documents (``max_documents``, smallest hashes of
the id first; one of each set of equal texts), in Spark: features are counted by label there and
the most telling ones (``max_features``) become the vocabulary; the sample comes to the driver
as short lists of vocabulary indices. Scoring is one pass over the texts without a shuffle.

Cases: null and empty texts have no sentence and score the leak; without any labelled row of
either kind every score is 0; a null label teaches nothing; repeated rows give repeated rows; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, id_and_text, slices

#: A run without a sentence end; it is a sentence if it has a word.
RUN = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


#: Words whose weights a worker remembers.
REMEMBERED_WORDS = 300_000


def features(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a star."""
    return [word, *(word[:k] + "*" for k in range(2, min(6, len(word))))]


@dataclass
class Model:
    """Feature weights (all above zero), the log-odds of a sentence without any, and the leak."""

    weights: dict[str, float]
    bias: float
    leak: float

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def heavy(self, words: set[str]) -> dict[str, float]:
        """The words with a weight, with their weights."""
        known = self.known
        for w in words:
            if w in known:
                continue
            if len(known) > REMEMBERED_WORDS:
                known = self.known = {}
            known[w] = sum([self.weights.get(f, 0.0) for f in features(w)])
        return {w: x for w in words if (x := known.get(w, 0.0))}

    def sentences(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """How many sentences have a word, and (start, end, log-odds) of those with a weighted one."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals have longer small forms; positions must hold
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        count = sum(WORD.search(run) is not None for run in RUN.findall(low))
        heavy = self.heavy(set(WORD.findall(low)))
        marked = []
        for m in RUN.finditer(low) if heavy else ():
            if own := heavy.keys() & set(WORD.findall(m.group())):
                marked.append((m.start(), m.end(), self.bias + sum(heavy[w] for w in sorted(own))))
        return count, marked

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or score, and (start, end, chance) of each sentence with a weighted word."""
        n, marked = self.sentences(text)
        odds = np.array([self.bias, *(z for _, _, z in marked)])
        times = np.array([n - len(marked)] + [1] * len(marked))
        score = 1 - (1 - self.leak) * float(np.exp(-(times * np.logaddexp(0, odds)).sum()))
        return min(1.0, max(0.0, score)), [(a, b, float(1 / (1 + np.exp(-z)))) for a, b, z in marked]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_documents: int, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of at most max_documents documents that models may learn from."""
    taught = labels.where(F.col(label).isNotNull() & ~held_out("doc_id"))
    ids = taught.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_documents)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("label").alias("label")).select("text", "label")


def vocabulary(sample: DataFrame, max_features: int, min_documents: int) -> list[str]:
    """The features whose document counts lean most to label 1, by a two-proportion z-score."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("word")
    starts = [F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in range(2, 6)]
    parts = sample.select("label", F.xxhash64("text").alias("doc"), words).select("label", "doc", F.explode(F.array_compact(F.array("word", *starts))).alias("word")).distinct()
    counts = parts.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not totals["ones"] or totals["ones"] == totals["n"]:
        return []
    rate = totals["ones"] / totals["n"]
    z = (F.col("ones") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = counts.where(F.col("n") >= min_documents).withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "word").limit(max_features)
    return [r["word"] for r in best.collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_documents: int = 8_000, max_features: int = 2_000, min_documents: int = 5, penalty: float = 1.0, rounds: int = 200, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on labels (doc_id, label) of the rows that are not held out."""
    sample = cut(labelled_sample(docs, labels, label, max_documents, id_col, text_col), "sample")
    words = vocabulary(sample, max_features, min_documents)
    if not words:
        return Model({}, -50.0, 0.0)
    number = {w: k for k, w in enumerate(words)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Model(dict.fromkeys(words, 1.0), 0.0, 0.0)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            count, found = [], []
            for text in batch.column(0).to_pylist():
                n, marked = finder.sentences(text)
                count.append(n)
                own = [sorted(set(WORD.findall(text[a:b].lower()))) for a, b, _ in marked]
                found.append([[number[f] for w in x for f in features(w) if f in number] for x in own])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(count, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["label", "n", "found"])

    rows = sample.mapInArrow(encode, "label int, n long, found array<array<int>>").collect()
    rows = sorted((r["label"], r["n"], r["found"]) for r in rows)
    label_of = np.array([r[0] for r in rows], float)
    plain = np.array([r[1] - len(r[2]) for r in rows], float)  # sentences without a word of the vocabulary
    owner = np.array([d for d, r in enumerate(rows) for _ in r[2]], np.int64)
    sentence = np.array([s for s, x in enumerate(x for r in rows for x in r[2]) for _ in x], np.int64)
    word = np.array([w for r in rows for x in r[2] for w in x], np.int64)
    return descend(words, label_of, plain, owner, sentence, word, penalty, rounds)


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def gradient(theta, label, plain, owner, sentence, word) -> np.ndarray:
    """Of the mean loss of the documents: minus the logarithm of the chance that the noisy-or gives their labels."""
    z = theta[-1] + np.bincount(sentence, theta[word], len(owner))
    none = np.logaddexp(0, theta[-2]) + plain * np.logaddexp(0, theta[-1]) + np.bincount(owner, np.logaddexp(0, z), len(label))  # -log(1 - P)
    # d loss / d none is 1 for label 0, and -(1 - P) / P for label 1
    pull = np.where(label > 0, -1 / np.maximum(np.expm1(np.minimum(none, 50)), 1e-9), 1.0)
    each = pull[owner] * logistic(z)
    return np.append(np.bincount(word, each[sentence], len(theta) - 2), [pull.sum() * logistic(theta[-2]), (pull * plain).sum() * logistic(theta[-1]) + each.sum()]) / len(label)


def descend(words, label, plain, owner, sentence, word, penalty: float, rounds: int) -> Model:
    """Adam on the leaky noisy-or likelihood; weights stay at zero or above, under an L1 penalty that grows in the first half.

    The last two parameters are the log-odds of the leak and of a sentence without features.
    """
    size = len(words)
    theta, m, v = np.zeros(size + 2), np.zeros(size + 2), np.zeros(size + 2)
    theta[-2] = np.log(max(1e-6, label.mean() / 2))
    theta[-1] = theta[-2] - np.log(max(1.0, plain.mean())) - 2
    theta[:-2] = -theta[-1] - 1  # from zero, no sentence would have a chance that the penalty doesn't outweigh
    for step in range(1, rounds + 1):
        grad = gradient(theta, label, plain, owner, sentence, word)
        grad[:-2] += penalty * min(1.0, 2 * step / rounds) / len(label)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.3 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
        theta[:-2] = np.maximum(theta[:-2], 0)
    return Model({w: float(x) for w, x in zip(words, theta) if x > 1e-3}, float(theta[-1]), float(logistic(theta[-2])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sentence_from: float = 0.3) -> DataFrame:
    """doc_id, score, offending: the sentences (start, end in code points, chance) at or above sentence_from."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
        for batch in (part for whole in batches for part in slices(whole)):
            got = [model.document(t) for t in batch.column(1).to_pylist()]
            offending = [[{"start": a, "end": b, "chance": p} for a, b, p in x if p >= sentence_from] for _, x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(offending, spans)], ["doc_id", "score", "offending"])

    return id_and_text(docs, id_col, text_col).mapInArrow(each, "doc_id long, score double, offending array<struct<start: int, end: int, chance: double>>")


def sentence_text(text: Column, span: Column) -> Column:
    """The words of an offending sentence, from the document's text."""
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])
