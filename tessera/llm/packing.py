"""Packing token sequences by minimum bin slack.

A document longer than the window fills windows of its own; what is left of each document is a
piece shorter than the window. Pieces of one length are alike, so the plan needs only how many
there are of each length: fewer numbers than the window has positions, however large the
corpus. For each next window the plan takes the longest remaining piece, and a bitset
subset-sum programme over the remaining multiset finds the sum closest to the capacity; the
counts are traced back, and the pattern repeats as often as the counts allow. Spark then deals
the pieces to the slots of the plan by their rank among the pieces of their length, which two
levels of counting give without ever gathering one length in one task.

Cases: a null text is empty and holds the end token alone; repeated ids are separate documents
with equal rows as far as their ids go; an empty table gives an empty table; other columns are
ignored. Ranks follow (doc_id, start), so the packing is the same in every run.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, slices

#: Parts of words that a worker remembers; later ones are solved batch by batch.
REMEMBERED_PARTS = 400_000
#: Parts that the library gets as one text.
AT_ONCE = 10_000
#: Parts among which the pieces of one length are ranked.
PARTS = 256


#: The rules of the vocabulary files that ``WordEncoder`` can split by words, as such a file states them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of plain text: ASCII and the letters from U+00C0 to U+00FF, which no normal form changes when no others are beside them.
PLAIN = bytes([*range(0x80), 0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))])
ODD = np.array([b not in PLAIN for b in range(256)])
#: Such text in small letters.
SMALL = bytes(b + 32 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256))
#: What the bytes of such text are: letters, digits, white space, others. Parts are runs of one kind, but each digit is one.
LETTER, DIGIT, WHITE, OTHER = range(4)
KIND = np.array([WHITE if b in b"\t\n\v\f\r " else DIGIT if b in b"0123456789" else LETTER if b >= 0x80 or 0x61 <= b <= 0x7A else OTHER for b in range(256)], np.uint8)
#: What makes a part of its own with the apostrophe before it.
SHORTENED = [[c] for c in b"stmd"], [[*b"re"], [*b"ve"], [*b"ll"]]


def splits_by_words(path: str) -> bool:
    """Whether the rules of a vocabulary file are those above, so that the ids of a text are those of its words."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    same = len(steps) == 2 and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": WORD_RULE}, "Removed", True)
    bytewise = same and (steps[1]["type"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ("ByteLevel", False, False)
    ends = rules["model"].get("end_of_word_suffix")
    return bool(ends) and bytewise and (rules["normalizer"] or {}).get("normalizers") == NORMALIZERS and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(t["content"].split()) != 1 for t in rules["added_tokens"])


class WordEncoder:
    """Ids as the library gives them.

    Where the vocabulary's rules never reach across white space (``splits_by_words``), plain words are cut into parts
    in small letters, and the library gets those that a batch of texts lacks, each once, many as one text: the last id
    of a part says that it ends a word. Words with other letters or special strings go to it as they are. What a worker
    remembers is bounded. Under any other rules the library gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.by_words = splits_by_words(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content.encode().translate(SMALL) for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        if self.by_words:
            self.cut_already = Tokenizer.from_file(path)
            self.cut_already.no_padding()
            self.cut_already.no_truncation()
            self.cut_already.normalizer = None
            self.cut_already.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix, vocabulary = self.library.model.end_of_word_suffix, self.library.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded_parts(self, parts: list[bytes]) -> list[bytes]:
        ids = np.array(self.cut_already.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(parts):  # the vocabulary lacks some byte
            return self.encoded([p.decode() for p in parts])
        found, ends = ids.tobytes(), ends.tolist()
        return [found[a:b] for a, b in zip([0, *ends], ends)]

    def cut_up(self, texts: list[str]) -> tuple[pa.Array, set[bytes], np.ndarray]:
        """Parts of all texts with the white space between them, the words that stay whole, and for each text the white space behind it."""
        data = b" ".join([*map(str.encode, texts), b"  "])
        small = data.translate(SMALL)
        given, letters = np.frombuffer(data, np.uint8), np.frombuffer(small, np.uint8)
        kind = KIND[letters]
        odd = np.append(np.flatnonzero(ODD[given]), [m.start() for s in self.special for m in re.finditer(re.escape(s), small)]).astype(np.int64)
        first = last = inside = odd
        if len(odd):
            white = np.flatnonzero(kind == WHITE)
            nth = np.unique(np.searchsorted(white, odd))
            first, last = np.append(0, white + 1)[nth], white[nth]
            edges = np.zeros(len(data), np.int8)
            edges[first], edges[last] = 1, -1
            inside = np.cumsum(edges, dtype=np.int8).astype(bool)
            letters = np.where(inside, given, letters)
        starts = np.ones(len(data), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        short = np.flatnonzero(letters == ord("'"))
        short = short[starts[short]]
        for n, ends in enumerate(SHORTENED, 1):
            found = short[(letters[short[:, None, None] + np.arange(1, n + 1)] == np.array(ends)).all(2).any(1)]
            starts[found + 1], starts[found + n + 1] = False, True
        starts[inside] = False
        starts[first] = starts[last] = True
        offsets, small = np.append(np.flatnonzero(starts), len(data)).astype(np.int32), letters.tobytes()
        parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(small)])
        behind = np.cumsum([len(t.encode()) + 1 for t in texts]) - 1
        return parts, {small[a:b] for a, b in zip(first.tolist(), last.tolist())}, np.searchsorted(offsets, behind, "right") - 1

    def ids_of(self, parts: list[bytes], others: set[bytes]) -> list[bytes]:
        """The ids of distinct parts, of which the words in others are whole."""
        known = self.known
        new = [p for p in parts if p not in known]
        known.update((p, b"") for p in new if p.isspace())
        whole = [p for p in new if p in others]
        plain = [p for p in new if p not in others and not p.isspace()]
        for k in range(0, len(plain), AT_ONCE):
            known.update(zip(plain[k : k + AT_ONCE], self.encoded_parts(plain[k : k + AT_ONCE])))
        known.update(zip(whole, self.encoded([p.decode() for p in whole])))
        found = [known[p] for p in parts]
        full = len(known) > REMEMBERED_PARTS
        for p in new:
            if full or len(p) >= 100:
                del known[p]
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, as little-endian unsigned 32-bit numbers."""
        if not self.by_words:
            return self.encoded(texts)
        parts, others, behind = self.cut_up(texts)
        coded = parts.dictionary_encode()
        distinct, place = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), others), coded.indices.to_numpy()
        sizes = np.array([len(x) // 4 for x in distinct], np.int64)
        first, n = (np.cumsum(sizes) - sizes)[place], sizes[place]
        end = np.cumsum(n)
        found = np.frombuffer(b"".join(distinct), "<u4")[np.repeat(first - (end - n), n) + np.arange(n.sum())]
        ends = end[behind].tolist()
        return [found[a:b].tobytes() for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and the ids): each document's windows and its rest."""
    last = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path).ids
        for batch in (part for whole in batches for part in slices(whole)):
            rows: list[tuple] = []
            found = [ids + last for ids in of(batch.column(1).to_pylist())]
            for doc, ids in zip(batch.column(0).to_pylist(), found):
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)]
            if with_ids:  # pieces follow each other as the documents' ids do
                ends = np.concatenate([[0], np.cumsum(columns[2].to_numpy())]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4").view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(split, schema)


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length sum closest to room without exceeding it: longer pieces first among equals.

    Bit k of a bitset says that the sum k can be reached with the items so far. Counts are split
    into powers of two, so each length costs a few shifts; the sums are traced back from the
    best one.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    items: list[tuple[int, int]] = []
    before: list[int] = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            items.append((length, take))
            before.append(reach)
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for (length, take), without in zip(reversed(items), reversed(before)):
        if not without >> best & 1:
            best -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces of it in one window, windows, first window, offset in the window) of each step."""
    left = {k: n for k, n in histogram.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    steps, windows = [], 0
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if n - (k == longest) > 0 and k <= window - longest}
        pattern = closest(rest, window - longest) if longest < window else {}
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            steps.append((length, rank[length], n, times, windows, offset))
            offset += n * length
            rank[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        windows += times
    return steps


def pack(parts: DataFrame, window: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...): at most window tokens a sequence, no gaps."""
    spark = parts.sparkSession
    parts = cut(parts, "pieces")
    # one row for each length at most: fewer than the window has positions
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    schema = "length long, rank long, per long, times long, first long, place long"
    steps = spark.createDataFrame(plan(histogram, window), schema)
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(PARTS)).alias("part")
    dealt = parts.withColumn("part", part)
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start"))
    ranked = dealt.withColumn("within", within).join(sizes, ["length", "part"]).withColumn("r", F.col("before") + F.col("within") - 1).drop("part", "before", "within")
    steps = steps.withColumnRenamed("length", "step_length")
    found = ranked.join(F.broadcast(steps), (F.col("length") == F.col("step_length")) & (F.col("r") >= F.col("rank")) & (F.col("r") < F.col("rank") + F.col("per") * F.col("times")))
    nth = F.col("r") - F.col("rank")
    sequence = (F.col("first") + F.expr("(r - rank) div per")).cast("long")
    offset = F.col("place") + (nth % F.col("per")) * F.col("length")
    return found.select(*parts.columns, sequence.alias("sequence_id"), offset.alias("offset"))
