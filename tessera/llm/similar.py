"""Exact similarity of texts by their sets of word shingles (Jaccard, at least 4/5).

A text's set holds the 64-bit hashes of its runs of ``shingle`` words (lower case by A-Z; all
words, in shorter texts). Let all hashes have one order. Two sets of at least that similarity
share one of the first n - ceil(4/5 n) + 1 hashes of each (prefix filter), so lines that
share none there need not meet (``line_dedup``). Any order is right: common hashes, found in a
sample, come last, which only saves work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: The least similarity, as a fraction.
P, Q = 4, 5
#: Puts a word's place into the hash of a run of words.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Texts of the sample that tells which hashes are common, and the most hashes that it names; both only steer the order.
SAMPLE, COMMON = 5000, 100_000


def run_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The hash of each run of so many words, made of its words' hashes; fewer words are one run, no word has the hash of nothing."""
    n = len(words) - shingle + 1
    if n <= 0:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    value = own[:n].copy()
    for k in range(1, shingle):
        value *= MIX
        value += own[k : k + n]
    return value


def distinct(values: np.ndarray) -> np.ndarray:
    """Each of the values once, ascending (``np.unique`` hashes them, which takes several times as long)."""
    own = np.sort(values)
    new = own[1:] != own[:-1]
    return own if new.all() else np.concatenate([own[:1], own[1:][new]])


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of the text's shingles, ascending; a text without a word has that of nothing."""
    return distinct(run_hashes(text.lower().split(), shingle).view(np.int64))  # bytes: A-Z alone, and the six white space bytes alone


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sets (ascending, not empty) have in common."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def prefix_length(n: int) -> int:
    """How many first hashes of n any similar enough set shares one of."""
    return n + (-P * n) // Q + 1 if n else 0


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of texts (node, text as binary)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), lists(found)], ["node", "hashes"])

    return texts.select("node", "text").mapInArrow(each, "node long, hashes array<long>")


def common_hashes(texts: DataFrame, shingle: int) -> np.ndarray:
    """Hashes that several texts of a sample hold, ascending."""
    step = max(1, texts.count() // SAMPLE)
    some = sets_of(texts.where(F.pmod(F.xxhash64("node"), F.lit(step)) == 0), shingle)
    found = some.select(F.explode("hashes").alias("h")).groupBy("h").count().where("count >= 4").orderBy(F.desc("count")).limit(COMMON).collect()
    return np.sort(np.array([r["h"] for r in found], np.int64))


def possible(n: str, place: str, m: str, other: str) -> str:
    """SQL: whether sets of n and m hashes whose first shared hash stands at these places can be similar enough.

    All that they share stands there or behind it. Similar sets pass at the first hash that they share, so a pair that
    passes at none of its shared hashes is not similar.
    """
    return f"{P} * {n} <= {Q} * {m} and {P} * {m} <= {Q} * {n} and {P + Q} * least({n} - {place}, {m} - {other}) >= {P} * ({n} + {m})"


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough.

    The texts that the pairs name are dealt out by node and met by the nodes' numbers alone, without a sort.
    """
    pairs = cut(pairs.select("a", "b").distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(texts.select("node", "text").join(nodes.hint("shuffle_hash"), "node", "left_semi"), "wanted")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, before, one = [], None, None
            for k in range(batch.num_rows):
                x, y = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                if x != before:  # pairs of one node often follow each other
                    before, one = x, shingle_set(x, shingle)
                two = shingle_set(y, shingle)
                both = shared(one, two)
                keep.append(Q * both >= P * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: wanted.select(F.col("node").alias(s), F.col("text").alias(f"{s}_text"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long")
