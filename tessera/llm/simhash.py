"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints (of 64 bits, or more words of 64) are put into tiles by the population
counts of their two halves. Two fingerprints that differ in at most ``radius`` bits have
population counts that differ by at most that in sum, so only such pairs of tiles are listed;
all others are skipped. The list holds numbers of tiles alone; each pair of it is a row of the
shuffle, so pairs spread over the tasks whatever a class holds, and a pair's work is bounded.
Within a pair, numpy takes exclusive-or and bit counts in blocks, again skipping blocks whose
population counts are too far apart. A pair of tiles returns a spanning forest of its links: no
connection is lost, and a group of n near copies gives in the order of n links instead of n
squared. Copies with one fingerprint are one node.

The work on tiles grows with the square of the distinct fingerprints; the classes cut it by a
constant. That is the price of an exact comparison without an index.

``similar_documents`` uses wider fingerprints of distinct shingles as a net and decides by the
exact similarity of the sets: first the links of the forests, then, where some of these fail, every
pair within the radius that the others have not joined, unless the sets' sizes or bits exclude it.
There the sets' sizes make the classes, since population counts of so wide a radius exclude next to
nothing: only sets of which neither is over 5/4 of the other's size meet, within tiles too.

Cases: a null text is empty; texts without a word have fingerprint zero and link like any
other (in ``similar_documents`` they are equal); repeated ids give repeated rows; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import cut, id_and_text, release, slices
from .components import components

#: Fingerprints of a tile at most, about: 256 kB, and a second or two for a pair.
TILE = 32_768
#: Comparisons that one numpy block makes: its arrays fit the cache.
BLOCK = 1 << 18
#: Bits that a set's elements set in ``similar_documents``, and its tiles: two words a node, some ten seconds for a pair.
SET_BITS, WIDE_TILE = 512, 65_536
#: Sizes of a class are at most so many times each other: a little over 5/4, so that sets of neighbouring classes alone can be similar.
SIZE_CLASS = 1.26


def hashes_of(text: bytes, shingle: int, seed: int) -> list[int]:
    """Hashes of the word shingles of UTF-8 text, with repeats; of all words, if there are fewer; none without a word."""
    words = text.lower().split()  # bytes: A-Z alone, and the six white space bytes alone
    hashed, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return [hashed(joined, seed)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    return [hashed(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]


def majority(values: np.ndarray) -> int:
    """The bits set in over half the values, as a signed integer; zero of none."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(values), 65536):
        part = np.unpackbits(np.ascontiguousarray(values[k : k + 65536]).view(np.uint8), bitorder="little").reshape(-1, 64)
        upto = len(part) // 255 * 255  # so many bits a byte can count
        bits += part[:upto].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        bits += part[upto:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(bits * 2 > len(values), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Of UTF-8 text: the bits set in over half the hashes of its word shingles, as a signed integer."""
    return majority(np.array(hashes_of(text, shingle, seed), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(each, "doc_id long, fp long")


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of i and j, pair by pair; label holds each member's first member."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            onward = label[label]
            if (onward == label).all():
                break
            label[:] = onward


def close_pairs(left: np.ndarray, right: np.ndarray | None, radius: int, sizes: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the rows of two tiles (or one) that differ in at most radius bits, block by block; words are columns.

    With the sizes of the tiles' sets, blocks of sizes that exclude a similarity of 4/5 are skipped instead of population counts too far apart.
    """
    one = right is None
    if sizes is None:
        keys = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (left, left if one else right)]
        least, most = lambda c: c - radius, lambda c: c + radius
    else:
        keys = [sizes[0].astype(np.int64), sizes[-1].astype(np.int64)]
        least, most = lambda n: -(-similar.P * n // similar.Q), lambda n: similar.Q * n // similar.P
    order = np.argsort(keys[0], kind="stable")
    other = order if one else np.argsort(keys[1], kind="stable")
    x, y = left[order], (left if one else right)[other]
    cx, cy = keys[0][order], keys[1][other]
    columns, bits = [np.ascontiguousarray(y[:, w]) for w in range(y.shape[1])], np.uint8 if 64 * y.shape[1] < 256 else np.uint16
    a = 0
    while a < len(x):
        z = min(len(x), a + 64)
        b = max(a + 1 if one else 0, int(np.searchsorted(cy, least(cx[a]))))
        end = int(np.searchsorted(cy, most(cx[z - 1]), "right"))
        step = max(64, BLOCK // (z - a))
        for k in range(b, end, step):
            upto = min(end, k + step)
            total = np.bitwise_count(x[a:z, 0, None] ^ columns[0][None, k:upto]).astype(bits, copy=False)
            for w in range(1, len(columns)):
                total += np.bitwise_count(x[a:z, w, None] ^ columns[w][None, k:upto])
            i, j = np.nonzero(total <= radius)
            if one:
                i, j = i[k + j > a + i], j[k + j > a + i]
            if len(i):
                yield order[a + i], other[k + j]
        a = z


def tiles_of(nodes: DataFrame, width: int, radius: int, tile: int) -> DataFrame:
    """(tile, lo, hi, and each column of nodes in an array): those of array columns follow one another.

    nodes: node, words (an array of width fingerprint words), and more. lo and hi are classes of the population counts of the two halves;
    with the size of a node's set, lo is its class and hi is 0.
    """
    step = max(1, radius // 4)
    if "size" in nodes.columns:
        step, parts = 1, [F.log(F.greatest("size", F.lit(1))) / math.log(SIZE_CLASS), F.lit(0)]
    elif width == 1:
        word, half = F.col("words")[0], 0xFFFFFFFF
        parts = [F.bit_count(word.bitwiseAND(F.lit(half))), F.bit_count(F.shiftrightunsigned(word, 32))]
    else:
        count = lambda a, b: sum((F.bit_count(F.col("words")[w]) for w in range(a + 1, b)), F.bit_count(F.col("words")[a]))
        parts = [count(0, width // 2), count(width // 2, width)]
    classes = nodes.select("*", *[F.floor(p / step).cast("int").alias(n) for p, n in zip(parts, ("lo", "hi"))])
    sizes = classes.groupBy("lo", "hi").agg(F.ceil(F.count("*") / tile).alias("chunks"))  # a row for each class: 33 * 33 for 64 bits, under 100 sizes
    dealt = classes.join(F.broadcast(sizes), ["lo", "hi"]).withColumn("chunk", F.pmod(F.xxhash64("node", "words"), "chunks"))
    packed = dealt.groupBy("lo", "hi", "chunk").agg(F.sort_array(F.collect_list(F.struct(*nodes.columns))).alias("m"))
    listed = [(F.flatten(f"m.{c}") if kind.startswith("array") else F.col(f"m.{c}")).alias(c) for c, kind in nodes.dtypes]
    return packed.select((F.col("lo").cast("long") * (1 << 48) + F.col("hi") * (1 << 32) + F.col("chunk")).alias("tile"), "lo", "hi", *listed)


def tile_pairs(tiles: DataFrame, radius: int, sized: bool = False) -> DataFrame:
    """(pair, side, tile): the pairs of tiles (or a tile with itself, one row) whose population counts, or classes of sizes, allow a link."""
    step = max(1, radius // 4)
    apart = lambda d: max(0, abs(d) * step - step + 1)  # noqa: E731  least difference of counts whose classes lie d apart
    most = radius // step + 1
    near = [(a, 0) for a in (-1, 0, 1)] if sized else [(a, b) for a in range(-most, most + 1) for b in range(-most, most + 1) if apart(a) + apart(b) <= radius]
    meets = F.explode(F.array(*[F.struct((F.col("lo") + a).alias("lo"), (F.col("hi") + b).alias("hi")) for a, b in near])).alias("to")
    own = tiles.select(F.col("tile").alias("a"), meets).select("a", "to.lo", "to.hi")
    found = own.join(tiles.select(F.col("tile").alias("b"), "lo", "hi"), ["lo", "hi"]).where("a <= b").select("a", "b")
    sides = F.expr("explode(if(a = b, array(named_struct('side', 0, 'tile', a)), array(named_struct('side', 0, 'tile', a), named_struct('side', 1, 'tile', b))))").alias("s")
    return found.select(F.struct("a", "b").alias("pair"), sides).select("pair", "s.side", "s.tile")


def may_be_similar(i: np.ndarray, j: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes, whose elements set these bits, can have a similarity of 4/5: no pair that has is lost.

    Sets of n and m elements may differ in (n + m) / 9 at most, and each bit that differs tells of one element.
    """
    n, m = size[i], size[j]
    differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
    return sizes_fit(i, j, size) & ((similar.P + similar.Q) * differ <= n + m)


def sizes_fit(i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have a similarity of 4/5."""
    return similar.Q * np.minimum(size[i], size[j]) >= similar.P * np.maximum(size[i], size[j])


def links(nodes: DataFrame, radius: int, width: int = 1, tile: int = TILE, forests: bool = True) -> DataFrame:
    """Links (a, b) of nodes (node, words) whose fingerprints lie within the radius.

    With forests, enough of them that exactly the nodes that any chain of links joins are joined; nodes with a size
    only link where the sizes of their sets allow a similarity of 4/5. Without forests, all those
    between nodes of different groups (group) that ``may_be_similar`` (size, bits) allows.
    """
    sized = "size" in nodes.columns
    nodes = nodes.select("node", "words", *(["size"] if sized else []), *([] if forests else ["group", "bits"]))
    names = nodes.columns
    tiles = cut(tiles_of(nodes, width, radius, tile), "tiles")
    sides = tile_pairs(tiles, radius, sized).join(tiles.select("tile", *names), "tile")
    pairs = sides.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("side", *names))).alias("s"))
    pairs = pairs.select(*[F.get("s", F.lit(k))[c].alias(f"{c}{k}") for c in names for k in (0, 1)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [c[k].values for c in batch.columns]
                cells = {c: [v.to_numpy(zero_copy_only=False) for v in sides[2 * n : 2 * n + 2] if v is not None] for n, c in enumerate(names)}
                x, *y = (w.view(np.uint64).reshape(-1, width) for w in cells["words"])
                own = {c: np.concatenate(v) for c, v in cells.items() if c != "words"}
                shift = len(x) if y else 0
                close = ((i, j + shift) for i, j in close_pairs(x, y[0] if y else None, radius, cells.get("size")))
                if forests:
                    label = np.arange(len(own["node"]))
                    for i, j in close:
                        fits = sizes_fit(i, j, own["size"]) if sized else slice(None)
                        unite(label, i[fits], j[fits])
                    member = np.flatnonzero(label != np.arange(len(label)))
                    found = [(member, label[member])]
                else:
                    bits = own["bits"].view(np.uint64).reshape(len(own["node"]), -1)
                    apart = ((i, j, own["group"][i] != own["group"][j]) for i, j in close)
                    kept = ((i[d], j[d]) for i, j, d in apart)
                    found = ((i[d], j[d]) for i, j in kept if len(i) and (d := may_be_similar(i, j, own["size"], bits)).any())
                for i, j in found:
                    yield pa.RecordBatch.from_arrays([pa.array(own["node"][i]), pa.array(own["node"][j])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that is reachable by links, its own included."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("words")), radius))
    linked = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "linked")
    release(nodes)
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = cut(linked.join(least, "root").select("fp", "component_id"), "classes")
    release(linked)
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def set_prints(texts: DataFrame, shingle: int, width: int, seed: int) -> DataFrame:
    """(node, h1, h2, words, size, bits): of a text's set of shingles a 128-bit hash, a fingerprint of width words, its size, and SET_BITS bits that its elements set."""
    names = ["node", "h1", "h2", "words", "size", "bits"]
    lists = lambda values, each: pa.ListArray.from_arrays(pa.array(np.arange(len(values) // each + 1, dtype=np.int32) * each), pa.array(values))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            both, words, sizes = [], [], []
            bits = np.zeros((batch.num_rows, SET_BITS), bool)
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = similar.shingle_set(text, shingle)
                whole = xxhash.xxh3_128_intdigest(own.tobytes())
                both += (whole >> 64, whole & 0xFFFFFFFFFFFFFFFF)
                values = own.view(np.uint64)
                words += [majority(spread(values, seed + w)) for w in range(width)]
                bits[k, (spread(values, seed + width) % np.uint64(SET_BITS)).astype(np.int64)] = True
                sizes.append(len(own))
            table = np.array(both, np.uint64).view(np.int64).reshape(-1, 2)
            marks = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table[:, 0]), pa.array(table[:, 1]), lists(np.array(words, np.int64), width), pa.array(sizes, pa.int32()), lists(marks, SET_BITS // 64)], names)

    return texts.select("node", "text").mapInArrow(each, "node long, h1 long, h2 long, words array<long>, size int, bits array<long>")


def spread(x: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similar_documents(texts: DataFrame, shingle: int = 5, width: int = 2, radius: int = 36, seed: int = 42) -> DataFrame:
    """(node, root) of every text (node, text as binary; nodes differ): equal roots for texts linked by a similarity of 4/5 or more.

    The similarity is the exact one of the sets of word shingles (Jaccard). The fingerprints only choose what is
    compared: at a similarity of 4/5, 128 bits differ in 19.4 on average with a deviation of 4.1, so the radius of 36
    lies four deviations beyond, while fingerprints of unlike texts differ in 64 with a deviation of 5.7.
    """
    marks = cut(set_prints(texts, shingle, width, seed), "set-prints")
    once = cut(marks.groupBy("h1", "h2").agg(F.min("node").alias("rep"), *[F.first(c).alias(c) for c in ("words", "size", "bits")]), "sets-once")
    own = cut(marks.select("node", "h1", "h2").join(once.select("h1", "h2", "rep"), ["h1", "h2"]).select("node", "rep"), "own")
    release(marks)
    nodes = once.select(F.col("rep").alias("node"), "words", "size", "bits")
    near = cut(links(nodes, radius, width, WIDE_TILE), "near")
    first = cut(similar.verified(near, texts, shingle), "first-links")
    roots = components(first)
    # whatever else is within the radius of each other lies in one group of the forests, and matters where that holds several groups
    placed = cut(components(near).select("node", F.col("root").alias("whole")).join(roots, "node", "left").select("node", "whole", F.coalesce("root", "node").alias("group")), "placed")
    several = placed.groupBy("whole").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select("whole")
    some = cut(nodes.join(placed.join(several, "whole", "left_semi").select("node", "group"), "node"), "some")
    second = cut(similar.verified(links(some, radius, width, WIDE_TILE, forests=False), texts, shingle), "second-links")
    roots = components(first.union(second))
    release(once, near, first, placed, some, second)
    return own.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
