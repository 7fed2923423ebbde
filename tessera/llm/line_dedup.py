"""Near-duplicate lines by a deletion-neighbourhood join; the earliest line stays.

The unit of an edit is the word; ``edits`` is the bound, one by default: a word changed, added or missing.
Lines under ``min_words`` words have no near lines, and are left alone unless ``exact_words`` sends
them through the step for equal lines (the pipeline's stage does, for every line with a word), so one edit keeps a similarity of 0.8 at the
default of five. A line is dropped when the same line, or one within the bound, stands earlier
(by doc_id, then position), whether or not that one is itself dropped.

1. Equal lines are grouped by a 128-bit hash; only the earliest of each goes on.
2. ``edits`` edits leave one of edits + 1 parts of a line whole. Lines that share no part with
   another one of almost their length have no partner and leave here. This loses no pair and
   spares most lines their variants; only hashes move for it. The texts of the others are taken from the documents once.
3. These emit every variant within the bound as hashed keys: the line without each choice of up to
   ``edits`` of its words. Lines within the bound share a variant. With one edit, the place of the word
   is a part of the key: lines that share a variant and its place differ in that word alone, and a line that is
   another's variant lacks one word of it, so every member is near the earliest one of its key and a group of n lines gives
   n pairs (``one_edit_later``). With more, members that their key's earliest line is too far from meet the other earlier ones (``later_ones``).
4. Edit distance verifies each pair on the words themselves.
5. With ``shingle`` (the pipeline's stage), lines whose sets of shingles have a Jaccard similarity of
   4/5 or more are near too, however many words differ: long lines may differ in several. They meet
   where they share one of their first hashes (``similar``), in the same way.

The plan is the same at every size; what is broadcast, Spark decides by its own threshold.

Cases: a null text has one empty line and drops nothing; repeated lines within a document
count like any others; equal ids in several rows are ordered by position alone (``dedup_lines``
then treats the rows alike), and lines of rows without an id have no near lines but equal ones, unless ``row_col`` names a
number that tells the rows apart; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import let

from . import similar
from .common import columns_of, cut, free, let_go, numbered, release, slices

#: Lines whose shingles a worker remembers, and their characters at most.
REMEMBERED_LINES, USUAL_LENGTH = 2048, 2000
#: Words of lines whose shingles are hashed together, about.
TOGETHER = 50_000
#: Lines that make a hash frequent, and how many frequent hashes the order knows: 3 MB.
HEAVY, FREQUENT = 8, 200_000
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def rows_of(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """(row, doc_id, text as binary): row is the number that tells rows apart, or else the id."""
    columns = [F.col(row_col or id_col).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id")]
    return docs.select(*columns, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def shingles_of(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of a line's runs of so many words, ascending; of all words, in shorter lines."""
    return similar.distinct(similar.run_hashes(words, shingle).view(np.int64))


def sets_of_lines(words: list[bytes], sizes: list[int], shingle: int, turned: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Iterator[np.ndarray]:
    """``shingles_of`` for lines of so many words that follow one another in words, hashed together: unsigned, and each hash turned into another number."""
    runs, at = turned(similar.run_hashes(words, shingle)), 0
    for n in sizes:
        yield similar.distinct(runs[at : at + n - shingle + 1] if n >= shingle else turned(similar.run_hashes(words[at : at + n], shingle)))
        at += n


def first_keys(words: list[bytes], sizes: list[int], shingle: int, common: np.ndarray) -> Iterator[np.ndarray]:
    """For each of these lines (``sets_of_lines``) the first of its shingles' hashes; common ones (ascending) come last.

    A key is a hash less its last bit, behind a bit that says whether it is common.
    """

    def keyed(own: np.ndarray) -> np.ndarray:
        found = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own if len(common) else np.zeros(len(own), bool)
        return own >> np.uint64(1) | found.astype(np.uint64) << np.uint64(63)

    return (keys[: similar.prefix_length(len(keys))].view(np.int64) for keys in sets_of_lines(words, sizes, shingle, keyed))


def parts_of(words: list[bytes], edits: int) -> list[int]:
    """Hashes of what edits may leave whole, for partners of as many words and up to edits more or less.

    Of the shorter line of a pair, cut into edits + 1 parts, one stands in the longer line at its own place from
    the start or moved by at most edits words. The place in the shorter line and its length go into the hash.
    """
    found, n = set(), len(words)
    for least in range(max(1, n - edits), n + 1):
        bounds = [k * least // (edits + 1) for k in range(edits + 2)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            for shift in range(n - least + 1) if edits == 1 else range(max(-edits, -a), min(edits, n - b) + 1):
                if edits == 1 and shift != (n - least) * k:  # the first half keeps its distance from the start, the last from the end
                    continue
                found.add(xxhash.xxh64_intdigest(b" ".join(words[a + shift : b + shift]), (least * (edits + 1) + k) & 0xFFFFFFFF))
    return sorted(found)


def marked_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int, row_col: str | None = None, exact_words: int | None = None, shingle: int | None = None, edits: int = 1) -> DataFrame:
    """(row, doc_id, pos, h1, h2, parts): each line of enough words with a 128-bit hash of its words.

    Lines of exact_words words (min_words by default) or more are marked; below min_words they have no parts (``parts_of``).
    With shingle, prefix is added: the first of the hashes of a line's shingles (``similar``).
    """
    names = ["row", "doc_id", "pos", "h1", "h2", "parts"] + ["prefix"] * bool(shingle)
    least_words = min_words if exact_words is None else exact_words
    rows = rows_of(docs, id_col, text_col, row_col)
    common = np.sort(similar.common_hashes(rows.select(F.col("row").alias("node"), "text"), shingle).view(np.uint64)) if shingle else None

    def fill(prefixes: list[np.ndarray], held: list[tuple[int, int]], words: list[bytes]) -> None:
        for (k, _), keys in zip(held, first_keys(words, [n for _, n in held], shingle, common) if held else ()):
            prefixes[k] = keys

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, none = xxhash.xxh3_128_intdigest, np.zeros(0, np.int64)
        for batch in (part for full in batches for part in slices(full, 2)):
            own, places, values, parts, ends = [], [], [], [], [0]
            prefixes, held, held_words = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for pos, line in enumerate(text.split(b"\n")):
                    words = line.split()  # bytes split at the six white space bytes alone
                    n = len(words)
                    if n < max(1, least_words):
                        continue
                    own.append(k)
                    places.append(pos)
                    both = whole(b" ".join(words))
                    values += (both >> 64, both & 0xFFFFFFFFFFFFFFFF)
                    if n >= min_words:
                        parts += parts_of(words, edits)
                    ends.append(len(parts))
                    if shingle:
                        prefixes.append(none)
                        if n >= min_words:
                            held.append((len(prefixes) - 1, n))
                            held_words += words
                        if len(held_words) >= TOGETHER:
                            fill(prefixes, held, held_words)
                            held, held_words = [], []
            fill(prefixes, held, held_words)
            table = np.array(values, np.uint64).view(np.int64).reshape(-1, 2)
            more = [similar.lists(prefixes)] if shingle else []
            parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(parts, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own, pa.int64())) for c in (0, 1)), pa.array(places, pa.int32()), pa.array(table[:, 0]), pa.array(table[:, 1]), parts, *more], names)

    return rows.mapInArrow(mark, "row long, doc_id long, pos int, h1 long, h2 long, parts array<long>" + ", prefix array<long>" * bool(shingle))


def sharing(keys: DataFrame, name: str) -> DataFrame:
    """(h1) of the lines that have a key (key, h1) with a line of another h1 in common, written.

    So are the common keys, so that what counting them moved is gone before all keys move again to meet them.
    """
    met = cut(keys.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least <> most").select("key"), "shared-keys")
    let_go(keys.sparkSession)
    found = cut(keys.join(met, "key").select("h1").distinct(), name)
    release(met)
    return found


def hashes_of(lines: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of lines (node, line): the hashes of their shingles, ascending."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for full in batches for part in slices(full)):
            lines = [t.split(b" ") for t in batch.column(1).to_pylist()]
            found = [x.view(np.int64) for x in sets_of_lines(list(itertools.chain.from_iterable(lines)), list(map(len, lines)), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), similar.lists(found)], ["node", "hashes"])

    return lines.select("node", F.col("line").cast("binary").alias("line")).mapInArrow(each, "node long, hashes array<long>")


def rare_first(lines: DataFrame, shingle: int) -> DataFrame:
    """(key, node, n, place): the first hashes of each line (node, line), those that fewer of these lines have before others.

    A line of which less than four fifths is common text has none of it among its first hashes, so such lines don't meet.
    The order knows the FREQUENT most frequent hashes apart; any order gives the same pairs. The result is written.
    """
    hashes = cut(hashes_of(lines, shingle), "line-hashes")
    counted = hashes.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(f"n >= {HEAVY}").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    let_go(lines.sparkSession)
    frequent = np.array([r["h"] for r in counted], np.int64)
    by_hash = np.argsort(frequent)
    known, rank = frequent[by_hash], by_hash.astype(np.int64)  # 0 is the most frequent

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = []
            for k in range(batch.num_rows):
                own = batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, len(known) - rank[at], 0), kind="stable")]
                firsts.append(own[: similar.prefix_length(len(own))])
            sizes = pa.array([len(x.values) for x in batch.column(1)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, similar.lists(firsts)], ["node", "n", "prefix"])

    rows = hashes.mapInArrow(each, "node long, n int, prefix array<long>")
    keys = cut(rows.select("node", "n", F.posexplode("prefix").alias("place", "key")).select("key", "node", "n", "place"), "rare-hashes")
    release(hashes)
    return keys


def texts_of(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """(h1, h2, first, line) of chosen lines (h1, h2, first: doc_id, row, pos), their words joined by one space."""
    by_doc = lines.groupBy("first.row").agg(F.collect_list(F.struct("first.doc_id", "first.pos", "h1", "h2")).alias("chosen"))
    rows = rows_of(docs, id_col, text_col, row_col).join(by_doc, "row")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for full in batches for part in slices(full)):
            found = []
            for row, text, chosen in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = text.split(b"\n")
                for c in chosen:
                    words = own[c["pos"]].split() if c["pos"] < len(own) else []
                    both = xxhash.xxh3_128_intdigest(b" ".join(words))
                    if both == (c["h1"] & 0xFFFFFFFFFFFFFFFF) << 64 | c["h2"] & 0xFFFFFFFFFFFFFFFF:  # ids may repeat
                        found.append((c["h1"], c["h2"], c["doc_id"], row, c["pos"], b" ".join(words)))
            columns = list(zip(*found)) if found else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h1", "h2", "doc_id", "row", "pos", "line"])

    rows = rows.select("row", "text", "chosen").mapInArrow(pick, "h1 long, h2 long, doc_id long, row long, pos int, line binary")
    return rows.dropDuplicates(["h1", "h2"]).select("h1", "h2", F.struct("doc_id", "row", "pos").alias("first"), F.col("line").cast("string").alias("line"))


def variant_keys(words: list[bytes], edits: int = 1) -> np.ndarray:
    """Hashes of the line without each choice of up to edits of its words, the whole line's last; equal words give equal hashes."""
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    terms = hashes * np.multiply.accumulate(powers)
    upto = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(terms)])
    if edits == 1:
        return np.append(upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(BASE_INVERSE), upto[-1])
    found, upto, mask = [], upto.tolist(), (1 << 64) - 1
    for size in range(edits, 0, -1):
        for gone in itertools.combinations(range(n), min(size, n)):
            value, factor, a = 0, 1, 0
            for k in (*gone, n):
                value, a, factor = value + (upto[k] - upto[a]) * factor, k + 1, factor * BASE_INVERSE & mask
            found.append(value & mask)
    return np.append(np.unique(np.array(found, np.uint64)), np.uint64(upto[-1]))


def variants(lines: DataFrame, edits: int = 1) -> DataFrame:
    """(key, node, place): each line (node, line) under the keys of its variants; the place of the word that a variant lacks, -1 for the whole line.

    With several edits, a key stands once and places are 0.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                keys = [variant_keys(x.split(b" "), edits) for x in part.column(1).to_pylist()]
                if edits > 1:
                    keys = [np.unique(x) for x in keys]
                row = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
                places = np.concatenate([np.append(np.arange(len(x) - 1), -1) if edits == 1 else np.zeros(len(x), int) for x in keys]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), part.column(0).take(pa.array(row)), pa.array(places)], ["key", "node", "place"])

    return lines.select("node", F.col("line").cast("binary").alias("line")).mapInArrow(emit, "key long, node long, place int")


def one_edit_later(lines: DataFrame, some: DataFrame) -> DataFrame:
    """(node) of the lines (node, line) within one edit of an earlier one; some are those that can be.

    Nodes are numbered in the order of lines. Each key gives a member one pair, with its earliest partner; the words verify it.
    Keys are made anew instead of written: to count them, to tell the lines that have one of those that stand twice, and, of these
    lines alone, with their places.
    """
    keys = variants(some)
    several = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several-keys")
    let_go(lines.sparkSession)
    members = cut(keys.select("key", "node").join(several, "key").select("node").distinct(), "members")
    let_go(lines.sparkSession)
    met = cut(variants(lines.join(members, "node", "left_semi")).join(several, "key"), "meeting")
    release(several, members)
    heads = met.where("place >= 0").groupBy("key", "place").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").drop("last")
    changed = met.join(heads, ["key", "place"]).where("node <> a").select("a", F.col("node").alias("b"))
    whole = met.where("place = -1").select("key", F.col("node").alias("whole"))
    lacking = met.where("place >= 0").groupBy("key").agg(F.min("node").alias("longer"))
    added = met.where("place >= 0").select("key", F.col("node").alias("longer")).join(whole, "key").where("whole < longer").select(F.col("whole").alias("a"), F.col("longer").alias("b"))
    missing = lacking.join(whole, "key").where("longer < whole").select(F.col("longer").alias("a"), F.col("whole").alias("b"))
    one, two = lines.select(F.col("node").alias("a"), F.col("line").alias("before")), lines.select(F.col("node").alias("b"), "line")
    pairs = changed.union(added).union(missing).distinct().join(one, "a").join(two, "b").select(F.col("b").alias("node"), "line", "before")
    found = cut(holding(pairs, lambda x, y: within_edits(x.split(b" "), y.split(b" "))).distinct(), "near")
    release(met)
    return found


def within_edits(a: list, b: list, edits: int = 1) -> bool:
    """Whether the word edit distance is at most edits; only so many diagonals are looked at."""
    n, m = len(a), len(b)
    if abs(n - m) > edits:
        return False
    front = next((k for k in range(min(n, m)) if a[k] != b[k]), min(n, m))
    back = next((k for k in range(min(n, m) - front) if a[-1 - k] != b[-1 - k]), min(n, m) - front)
    a, b = a[front : n - back], b[front : m - back]
    if min(len(a), len(b)) == 0 or edits == 1:
        return max(len(a), len(b)) <= edits
    row = {j: j for j in range(min(edits, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            row[j] = min(last.get(j, edits) + 1, row.get(j - 1, edits) + 1, last.get(j - 1, edits + 1) + (x != b[j - 1])) if j else i
    return row.get(len(b), edits + 1) <= edits


@lru_cache(maxsize=2)
def remembered_sets(shingle: int) -> Callable[[bytes], np.ndarray]:
    """The shingles of lines; a line meets several others one after the other, so those of lines of usual length are remembered."""
    of = lambda text: shingles_of(text.split(b" "), shingle)
    known = lru_cache(maxsize=REMEMBERED_LINES)(of)
    return lambda text: known(text) if len(text) <= USUAL_LENGTH else of(text)


def alike(a: bytes, b: bytes, shingle: int) -> bool:
    """Whether two lines, as words joined by spaces, have similar enough sets of shingles."""
    one, two = remembered_sets(shingle)(a), remembered_sets(shingle)(b)
    both = similar.shared(one, two)
    return similar.Q * both >= similar.P * (len(one) + len(two) - both)


def holding(pairs: DataFrame, holds: Callable[[bytes, bytes], bool]) -> DataFrame:
    """(node) of the pairs (node, line, before) that hold, as often as they do."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for full in batches for part in slices(full)):
            keep = [holds(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield batch.select(["node"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("node", F.col("line").cast("binary").alias("line"), F.col("before").cast("binary").alias("before")).mapInArrow(each, "node long")


def later_ones(keys: DataFrame, lines: DataFrame, holds: Callable[[bytes, bytes], bool], possible: Callable[[str, str, str, str], str] | None = None) -> DataFrame:
    """(node) of the lines (node, line) for which ``holds`` with an earlier one that has one of its keys (key, node, n, place).

    Nodes are numbered in the order of lines. Each meets the first of a key, and the other earlier ones only if that fails.
    possible says in SQL, of (n, place) of both sides, whether a pair need be looked at.
    """
    may = possible or (lambda *_: "true")
    heads = keys.groupBy("key").agg(F.min(F.struct("node", "n", "place")).alias("head"), F.max("node").alias("last")).where("head.node <> last").select("key", "head")
    met = cut(keys.join(heads, "key").where("node <> head.node"), "meeting")

    def near(pairs: DataFrame) -> DataFrame:
        one, two = lines.select(F.col("node").alias("a"), F.col("line").alias("before")), lines.select(F.col("node").alias("b"), "line")
        both = pairs.distinct().join(one, "a").join(two, "b").select(F.col("b").alias("node"), "line", "before")
        return cut(holding(both, holds).distinct(), "near")

    found = near(met.where(may("n", "place", "head.n", "head.place")).select(F.col("head.node").alias("a"), F.col("node").alias("b")))
    rest = met.join(found, "node", "left_anti").select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("other"))
    earlier = met.select("key", F.col("node").alias("a"), "n", "place")
    others = near(rest.join(earlier, "key").where("a < b").where(may("n", "place", "m", "other")).select("a", "b"))
    release(met)
    return found.union(others)


def near_lines(marks: DataFrame, firsts: DataFrame, docs: DataFrame, id_col: str, text_col: str, row_col: str | None, edits: int, shingle: int | None) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier near line. firsts: h1, h2, first. Releases marks, whose keys only the first steps read."""
    by_parts = sharing(marks.select("h1", F.explode("parts").alias("key")), "sharing")
    by_hashes = sharing(marks.select("h1", F.explode("prefix").alias("key")), "sharing-hashes") if shingle else None
    release(marks)
    wanted = by_parts.union(by_hashes).distinct() if shingle else by_parts
    candidates = cut(firsts.select("h1", "h2", "first").join(wanted, "h1", "left_semi"), "candidates")
    ordered = cut(texts_of(docs, candidates, id_col, text_col, row_col).orderBy("first"), "candidate-texts")
    release(candidates)
    lines = cut(numbered(ordered, "node"), "numbered-texts")  # by files and places: in the order of lines
    release(ordered)
    some = lines.join(by_parts, "h1", "left_semi")
    if edits == 1:
        near = one_edit_later(lines, some)
        release(by_parts)
    else:
        emitted = cut(variants(some, edits), "variants")
        near = later_ones(emitted.withColumn("n", F.lit(0)), lines, lambda x, y: within_edits(x.split(b" "), y.split(b" "), edits))
        release(by_parts, emitted)
    if shingle:
        keys = rare_first(lines.join(by_hashes, "h1", "left_semi"), shingle)
        near = near.union(later_ones(keys, lines, lambda x, y: alike(x, y, shingle), similar.possible))
        release(by_hashes, keys)
    found = cut(lines.join(near.distinct(), "node").select("h1", "h2"), "near-lines")
    release(lines)
    return found


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, row_col: str | None = None, exact_words: int | None = None, shingle: int | None = None, edits: int = 1) -> DataFrame:
    """doc_id, dropped: the positions, from 0 and ascending, of the lines that go; documents that lose none are absent.

    With row_col, a number that tells all rows apart, row takes the place of doc_id, and breaks ties of ids.
    """
    marks = cut(marked_lines(docs, id_col, text_col, min_words, row_col, exact_words, shingle, edits), "lines")
    places = cut(marks.select("row", "doc_id", "pos", "h1", "h2"), "line-places")
    place = F.struct("doc_id", "row", "pos")
    firsts = cut(places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")), "firsts")
    near = near_lines(marks, firsts, docs, id_col, text_col, row_col, edits, shingle)
    known = cut(firsts.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("times > 1 or near").select("h1", "h2", "first", "near"), "known")
    release(firsts, near)
    gone = places.join(known, ["h1", "h2"]).where("near or first.row <> row or first.pos <> pos or (first.row is null) <> (row is null)")
    return gone.groupBy(F.col("row").alias("row" if row_col else "doc_id")).agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, row_col: str | None = None, exact_words: int | None = None, shingle: int | None = None, edits: int = 1) -> DataFrame:
    """The table without its dropped lines; documents that lose every line with a word are gone.

    All columns stay; a text from which nothing is dropped (null too) stays as it is.
    """
    own, which = free(docs, "line_row"), free(docs, "line_dropped")
    gone = dropped_lines(docs, id_col, text_col, min_words, row_col, exact_words, shingle, edits).select(F.col("row" if row_col else "doc_id").alias(own), F.col("dropped").alias(which))

    def left(lines: Column) -> Column:  # split once, not again for each line
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(which))
        return F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n")

    text = F.when(F.col(which).isNull(), F.col(text_col)).otherwise(let(F.split(F.col(text_col), "\n", -1), left))
    joined = docs.join(cut(gone, "dropped"), F.col(row_col or id_col).cast("long") == F.col(own), "left").withColumn(text_col, text)
    return joined.where(F.col(which).isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*columns_of(docs))
