"""Document quality by regularised quadratic discriminant analysis over text statistics.

Each text gives a vector of transformed statistics (logarithms of sizes, square roots of
shares). Spark sums counts, vectors and outer products of the labelled rows by class, so every
labelled row that is not held out counts and only these sums reach the driver. Class
covariances shrink towards the pooled one, and that towards its mean variance. The score is
the posterior chance of label 1: the difference of the two log-densities (Mahalanobis
distances by the inverses of the Cholesky factors, which are computed once and go with the
model) and the log prior odds.

Cases: null and empty texts have a vector like any other; without labelled rows of both
classes every score is the share of label 1 (0.5 without any row); a null label teaches nothing; repeated rows
give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, id_and_text, slices

NAMES = ("log_words", "log_word_size", "unique", "symbols", "bars", "capitals", "shouts", "digits", "marks", "top_word", "dup_lines", "log_line_words", "repeats", "other")


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    size, words = max(1, len(text)), text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    count = lambda marks: sum(map(text.count, marks))
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, words))
    pairs = set(zip(words, words[1:]))
    share = lambda part, of: np.sqrt(max(0.0, part) / max(1, of))
    return [
        np.log1p(len(words)), np.log1p(letters / n), len(counts) / n if words else 0.0, share(count("#*$%&<>"), size), share(count("|"), n), share(upper, n), share(count("!"), size),
        share(count("0123456789"), size), share(count(".,;:"), size), share(max(counts.values(), default=0), n), share(len(lines) - len(set(lines)), len(lines)), np.log1p(len(words) / max(1, len(lines))),
        1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0, share(count("=_{}[]()/\\@+~^"), size),
    ]


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): one vector for each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return id_and_text(docs, id_col, text_col).mapInArrow(each, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse of the covariance's Cholesky factor, and half the covariance's log-determinant."""

    prior: float
    classes: tuple[tuple[float, np.ndarray, np.ndarray, float], ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        density = [share - half - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for share, mean, inverse, half in self.classes]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = 0.1, ridge: float = 0.02, split: bool = True) -> Discriminant:
    """From vectors (doc_id, x) and labels (doc_id, label) of the rows that are not held out; of all labels without split."""
    taught = labels.where(F.col(label).isNotNull() & (~held_out("doc_id") if split else F.lit(True))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = np.array(batch.column(0).to_pylist()).reshape(-1, d), batch.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        place = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], ["place", "value"])

    found = rows.join(taught, "doc_id").select("x", "label").mapInArrow(sums, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for r in found:  # as many rows as there are sums
        total[r["place"]] = r["value"]
    return discriminant(total.reshape(2, -1), d, shrink, ridge)


def discriminant(total: np.ndarray, d: int, shrink: float, ridge: float) -> Discriminant:
    n = total[:, 0]
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5, ())
    means = total[:, 1 : d + 1] / n[:, None]
    own = [t[d + 1 :].reshape(d, d) / k - np.outer(m, m) for t, k, m in zip(total, n, means)]
    pooled = (own[0] * n[0] + own[1] * n[1]) / n.sum()
    classes = []
    for k in (0, 1):
        cov = (1 - shrink) * own[k] + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(np.diag(pooled)) + 1e-9 * np.eye(d) * max(1e-9, np.trace(pooled))
        factor = np.linalg.cholesky(cov)
        classes.append((float(np.log(n[k] / n.sum())), means[k], np.tril(np.linalg.inv(factor)), float(np.log(np.diag(factor)).sum())))
    return Discriminant(float(n[1] / n.sum()), tuple(classes))


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of vectors (doc_id, x)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return rows.mapInArrow(each, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, score) of every row, by a model learned from the labels of those that are not held out.

    With row_col, a number that tells all rows apart, (row, score); labels still go by id.
    """
    if row_col is None:
        rows = cut(vectors(docs, id_col, text_col), "vectors")
        return score(rows, fit(rows, labels, label))
    rows = cut(vectors(docs, row_col, text_col), "vectors")
    ids = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"))
    taught = labels.join(ids, F.col("doc_id").cast("long") == F.col("id")).where(~held_out("doc_id"))
    model = fit(rows, taught.select(F.col("row").alias("doc_id"), label), label, split=False)
    return score(rows, model).withColumnRenamed("doc_id", "row")
