"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact check.

Words are runs of letters and digits (beyond ASCII: any byte) of the lower-cased text; a shingle
is five words (all of them, in shorter items) and weighs the letters in it. For each size of
item, every window of that many words that shares a shingle with some item gets a 64-bit
weighted SimHash. An index over eight blocks of eight bits finds all items of that size whose
fingerprint lies within ``radius`` bits: of any such pair, one block differs in at most
radius // 8 bits, so each item stands in the buckets of all values of each block that are so near,
and a window looks into the eight buckets of its own values. Weighted
Jaccard similarity of the shingles, with repeats, then verifies each candidate exactly. The
default radius lies over four standard deviations beyond the expected distance at a
similarity of 0.8.

Windows that share no shingle with any item have similarity zero, so fingerprints are only
computed where one is shared; to see that, a document's words are looked up among the items'
words and runs of found ones among the items' shingles. Documents never meet each other: no shuffle but the last
deduplication. Items up to ``GROUP_BYTES`` are one broadcast, and one scan of the documents; each worker
process builds its index once. More items make several groups, fetched and broadcast one after the
other, with a scan for each: the driver never holds more than one group, and nothing is left out.

Cases: null texts and items without a word match nothing; a document shorter than an item is
one window; repeated rows give one row for each (doc_id, item_id) with the best window, the
first among equals; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, id_and_text, slices

#: Bytes of items that one scan hands to each worker, about; an index takes some ten times that.
GROUP_BYTES = 16_000_000
BLOCKS = 8
#: Window fingerprints that are looked up at once, about.
LOOKED_UP = 100_000
#: Pairs of windows and items that are compared at once, about.
COMPARED = 2_000_000
TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Windows whose bits are summed at once.
WINDOWS = 4096


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(TO_SPACE).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of each shingle of words; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    value, weight = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(size):
        value = value * MIX + hashes[k : k + n]
        weight += sizes[k : k + n]
    return mixed(value), weight


def coded(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """One number for the codes at..at+size-1, for each place."""
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        value = value * MIX + codes[at + k]
    return mixed(value)


def simhashes(value: np.ndarray, weight: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Weighted SimHash of the shingles starts..starts+size-1, for each start (ascending)."""
    out = []
    for k in range(0, len(starts), WINDOWS):
        own = starts[k : k + WINDOWS]
        for run in np.split(own, np.flatnonzero(np.diff(own) > 4 * size) + 1):  # gaps need no sums
            a, b = run[0], run[-1] + size
            bits = np.unpackbits(value[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
            upto = np.zeros((b - a + 1, 64), np.int64)
            np.cumsum((2 * bits - 1) * weight[a:b, None], axis=0, out=upto[1:])
            over = upto[run - a + size] - upto[run - a] > 0
            out.append(np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0])
    return np.concatenate(out)


def similarity(a: list[bytes], b: list[bytes], size: int) -> float:
    """Weighted Jaccard similarity of two word lists' shingles, with repeats."""
    x, y = (Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) for w in (a, b))
    weigh = lambda c: sum(n * sum(map(len, s)) for s, n in c.items())
    both = weigh(x | y)
    return weigh(x & y) / both if both else 0.0


class Index:
    """Items by size, with a table for each block of the fingerprint."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int):
        self.radius, self.shingle = radius, shingle
        rows = sorted(((len(w), i, w) for i, t in items if (w := words_of(t))), key=lambda r: r[:2])
        self.items = [(i, w) for _, i, w in rows]
        sizes = np.array([r[0] for r in rows], np.int64)
        self.sizes = {int(n): (int(np.searchsorted(sizes, n)), int(np.searchsorted(sizes, n, "right"))) for n in np.unique(sizes)}
        self.codes: dict[bytes, int] = {}
        prints, weights, known = [], [], defaultdict(list)
        for _, w in self.items:
            size = min(shingle, len(w))
            value, weight = shingles(w, size)
            weights.append(weight.sum())
            codes = np.array([self.codes.setdefault(x, len(self.codes) + 1) for x in w], np.uint64)
            known[size].append(coded(codes, np.arange(len(w) - size + 1), size))
            prints.append(simhashes(value, weight, np.zeros(1, np.int64), len(value))[0])
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.prints, self.weights = np.array(prints, np.uint64), np.array(weights, np.int64)
        self.place = {n: k for k, n in enumerate(self.sizes)}
        of_item = np.repeat(np.arange(len(self.sizes)), [end - first for first, end in self.sizes.values()])
        every = np.arange(256, dtype=np.uint8)
        masks = every[np.bitwise_count(every) <= radius // BLOCKS]
        self.buckets = [self.bucketed(of_item, self.prints[:, None].view(np.uint8)[:, b], masks) for b in range(BLOCKS)] if len(rows) else []

    def bucketed(self, of_item: np.ndarray, values: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each size and each value of a block, the items of that size whose block lies near: all of them in order, and where each bucket starts."""
        keys = (of_item[:, None] * 256 + (values[:, None] ^ masks[None, :])).ravel()
        items = np.repeat(np.arange(len(values), dtype=np.int32), len(masks))
        counts = np.bincount(keys, minlength=256 * len(self.sizes))
        return items[np.argsort(keys, kind="stable")], np.concatenate([[0], np.cumsum(counts)])

    def close(self, prints: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius of an item of their size, given by its place among the sizes."""
        blocks, found = prints[:, None].view(np.uint8), []
        for b, (items, starts) in enumerate(self.buckets):
            key = size * 256 + blocks[:, b]
            lo = starts[key]
            many = starts[key + 1] - lo
            upto = np.cumsum(many)
            for part in np.split(np.arange(len(prints)), np.searchsorted(upto, np.arange(COMPARED, upto[-1], COMPARED))):
                w = np.repeat(part, many[part])
                i = items[np.arange(len(w)) + np.repeat(lo[part] - (np.cumsum(many[part]) - many[part]), many[part])].astype(np.int64)
                near = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
                found.append(w[near] * len(self.items) + i[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.items), pairs % len(self.items)

    def shared(self, words: list[bytes], shingle: int) -> np.ndarray:
        """For each place in words whether the shingle there is one of an item's."""
        codes = np.fromiter(map(self.codes.get, words, repeat(0)), np.uint64, len(words))
        n = len(words) - shingle + 1
        found = codes > 0
        runs = found[: max(0, n)].copy()
        for k in range(1, shingle):
            runs &= found[k : k + n]
        at = np.flatnonzero(runs)
        value, known = coded(codes, at, shingle), self.known[shingle]
        runs[at] = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
        return runs

    def scan(self, text: str, least: float) -> list[tuple[int, int, int, float]]:
        """(item_id, start, words, similarity) of the best window of each item that is similar enough."""
        words, found = words_of(text), []
        for shingle in self.known:
            if len(words) < shingle or not (hit := self.shared(words, shingle)).any():
                continue
            value, weight = shingles(words, shingle)
            shared, in_all, in_hits = (np.concatenate([[0], np.cumsum(x)]) for x in (hit, weight, hit * weight))
            best: dict[int, tuple[float, int]] = {}
            held: list[tuple[np.ndarray, int]] = []
            for n in self.sizes:
                size = min(n, len(words)) - shingle + 1
                if min(self.shingle, n) == shingle and len(starts := np.flatnonzero(shared[size:] > shared[: len(shared) - size])):
                    held.append((starts, n))
                    if sum(len(s) for s, _ in held) >= LOOKED_UP:
                        self.search(words, shingle, value, weight, in_all, in_hits, held, least, best)
                        held = []
            if held:
                self.search(words, shingle, value, weight, in_all, in_hits, held, least, best)
            found += [(self.items[i][0], start, min(len(self.items[i][1]), len(words)), alike) for i, (alike, start) in best.items()]
        return found

    def search(self, words, shingle, value, weight, in_all, in_hits, held, least, best) -> None:
        """Look the windows (starts, size) up and verify what is near; best: by item, its similarity and start."""
        width = {n: min(n, len(words)) - shingle + 1 for _, n in held}
        prints = np.concatenate([simhashes(value, weight, starts, width[n]) for starts, n in held])
        starts = np.concatenate([s for s, _ in held])
        count = [len(s) for s, _ in held]
        size, end = np.repeat([self.place[n] for _, n in held], count), starts + np.repeat([width[n] for _, n in held], count)
        w, i = self.close(prints, size)
        # what a window shares with all items together bounds what it shares with one
        most = (in_hits[end[w]] - in_hits[starts[w]]) / np.maximum(self.weights[i], in_all[end[w]] - in_all[starts[w]])
        for w, i in zip(*(x[most >= least].tolist() for x in (w, i))):
            start, own = int(starts[w]), self.items[i][1]
            alike = similarity(words[start : start + len(own)], own, shingle)
            if alike >= least and (i not in best or (alike, -start) > (best[i][0], -best[i][1])):
                best[i] = (alike, start)


#: The index that this worker process built last, by the name of its group.
built: dict[str, Index] = {}


def index_of(name: str, group: Broadcast, shingle: int, radius: int) -> Index:
    if name not in built:
        built.clear()
        built[name] = Index(group.value, shingle, radius)
    return built[name]


def groups_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of bounded size, fetched one after the other."""
    rows = id_and_text(items, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // GROUP_BYTES)
    for g in range(n):
        yield [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == g).collect()]


def benchmark_matches(docs: DataFrame, items: DataFrame, least: float = 0.8, radius: int = 22, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, n_words, similarity of each item found in a document: its best window of words."""
    rows = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, start long, n_words long, similarity double"

    def scanner(group: Broadcast):
        name = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(name, group, shingle, radius)
            for batch in (part for whole in batches for part in slices(whole)):
                found = [(d, *row) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in index.scan(t, least)]
                columns = list(zip(*found)) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.float64()])], ["doc_id", "item_id", "start", "n_words", "similarity"])

        return scan

    found = docs.sparkSession.createDataFrame([], schema)
    for group in groups_of(items, item_col, item_text_col):
        found = found.union(rows.mapInArrow(scanner(docs.sparkSession.sparkContext.broadcast(group)), schema))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start"), F.col("n_words"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.start", "m.n_words", (-F.col("m.s")).alias("similarity"))


def clean_documents(docs: DataFrame, items: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns."""
    own = free(docs, "leak")
    leaks = benchmark_matches(docs, items, least, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaks.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(own), "left_anti")
