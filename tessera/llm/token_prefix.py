"""Token counts at every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

For each byte position of a pre-token the programme stores the one token that ends the
encoding of that prefix.  A vocabulary token may end a prefix exactly when encoding the bytes
of the token before it and its own bytes gives these two tokens again, so the count at a
prefix is the count at the shorter prefix plus one.  Pre-tokens are joined into units (the
white space before a body, and the body) whose counts depend on nothing outside them; a unit
is solved once a worker and then looked up, because words repeat. Units that a batch of texts
lacks are solved together, one numpy step for each (start, end) of all words of one length.

``prefix_token_table`` keeps, for each document, the difference of successive counts: one
signed byte a code point.  ``tokens_at`` and ``truncate_to`` answer questions from that
table; no text is encoded again.

Cases: a null text is empty and has 0 tokens; repeated rows give repeated rows; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices

#: Units, and words between spaces, that a worker remembers; later ones are solved batch by batch.
REMEMBERED_UNITS = 400_000
#: Pairs of tokens that a worker remembers, as a power of two of slots that are half used at most.
PAIR_SLOTS = 1 << 21
#: Bytes of a word from which it is solved by itself.
LONG = 48
SPACE = r"\p{White_Space}"
NEVER = 1 << 60
HASH_BASE = 0xD6E8FEB86659FD93
#: A plain space beside other white space: words between spaces then depend on each other.
RUN = re.compile(r" \s|\s |^\s|\s$")
#: White space with the body after it. Counts inside a unit depend on that unit alone.
UNIT = regex.compile(rf"(?:{SPACE}*[^\P{{White_Space}} ])?'(?:[stmd]|re|ve|ll)|{SPACE}*(?:\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+)|{SPACE}+")
CONTRACTIONS = ("'re", "'ve", "'ll")
WHITE = {"", *(chr(c) for c in range(0x3001) if regex.match(SPACE, chr(c)))}
BODY = regex.compile(rf"{SPACE}*")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Whether one token can follow another, in open addressing over numpy arrays; forgets all when half full."""

    def __init__(self, decide):
        self.decide = decide
        self.keys, self.fits, self.used = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool), 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """For each key its slot, or the free slot where it belongs."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (PAIR_SLOTS - 1)
        while len(more := np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))):
            at[more] = (at[more] + 1) & (PAIR_SLOTS - 1)
        return at

    def __call__(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = before.astype(np.int64) << 20 | token
        at = self.slots(keys)
        new = self.keys[at] < 0
        if not new.any():
            return self.fits[at]
        fits = self.fits[at]
        fresh, back = np.unique(keys[new], return_inverse=True)
        verdict = np.array([self.decide(int(k) >> 20, int(k) & 0xFFFFF) for k in fresh], bool)
        fits[new] = verdict[back]
        if self.used + len(fresh) > PAIR_SLOTS // 2:
            self.keys[:], self.used = -1, 0
        if len(fresh) <= PAIR_SLOTS // 2:
            left, verdicts = fresh, verdict
            while len(left):  # two new keys may want one slot; the one that lost it looks on
                at = self.slots(left)
                self.keys[at] = left
                own = self.keys[at] == left
                self.fits[at[own]] = verdicts[own]
                left, verdicts = left[~own], verdicts[~own]
            self.used += len(fresh)
        return fits


class PrefixCounter:
    """Counts the tokens of every prefix of a text as the library does that owns the vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rules = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or (rules.get("type"), rules.get("add_prefix_space"), rules.get("use_regex")) != ("ByteLevel", False, True) or spec["model"]["type"] != "BPE" or spec["model"].get("ignore_merges") or spec["model"].get("end_of_word_suffix"):
            raise ValueError("the vocabulary's rules are not those of byte-level pair encoding without a normalizer")
        letters = byte_letters()
        special = {x["content"] for x in spec["added_tokens"]}
        raw = lambda s: bytes(letters[c] for c in s)
        self.names = sorted(raw(s) for s in spec["model"]["vocab"] if s not in special)
        self.tokens = set(self.names)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.made = {a + b: (k, a, b) for (a, b), k in self.rank.items()}
        if len(self.made) < len(self.rank):
            raise ValueError("two merges make the same token")
        self.longest = max(map(len, self.names))
        if self.longest > 128:
            raise ValueError("a difference of counts would not fit one signed byte")
        values = np.array([self.value(t) for t in self.names], np.uint64)
        order = np.argsort(values)
        self.values, self.numbers = values[order], order.astype(np.int32)
        if (self.values[1:] == self.values[:-1]).any():
            raise ValueError("two tokens have one hash")
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.values >> np.uint64(44)] = True
        self.nothing = len(self.names)
        self.pair_table = PairTable(lambda a, b: self.follows(b"" if a == self.nothing else self.names[a], self.names[b]))
        self.special = sorted(special, key=len, reverse=True)
        self.units: dict[str, tuple[bytes, int]] = {}
        self.words: dict[str, tuple[bytes, int]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    @staticmethod
    def value(token: bytes) -> int:
        value = 0
        for b in token:
            value = (value * HASH_BASE + b + 1) % (1 << 64)
        return value

    def solve(self, words: list[bytes]) -> np.ndarray:
        """Token counts at every byte prefix of words of one length: a row for each word."""
        m, n = len(words), len(words[0])
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(m, n)
        last, count = np.full((m, n + 1), self.nothing, np.int32), np.zeros((m, n + 1), np.int16)
        value = np.zeros((n, m), np.uint64)  # by start, of the bytes from there to the end reached so far
        for end in range(1, n + 1):
            value[:end] = value[:end] * np.uint64(HASH_BASE) + (letters[:, end - 1].astype(np.uint64) + np.uint64(1))
            open_ = np.ones(m, bool)
            for start in range(end):
                rows = np.flatnonzero(open_ & self.marks[value[start] >> np.uint64(44)])
                if not len(rows):
                    continue
                own = value[start, rows]
                at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
                hit = self.values[at] == own
                rows, token = rows[hit], self.numbers[at[hit]]
                fits = self.pair_table(last[rows, start], token)
                rows = rows[fits]
                last[rows, end], count[rows, end] = token[fits], count[rows, start] + 1
                open_[rows] = False
            if open_.any():
                raise ValueError("the vocabulary lacks a single byte")
        return count

    def follows(self, before: bytes, token: bytes) -> bool:
        """Whether a token can stand after another one (or alone, after nothing) in an encoding.

        Undo the merges that made the two, latest first: across the border, no pair may ever have
        met that would have been merged earlier (among equal merges, the leftmost comes first).
        """
        if len(self.pairs) > REMEMBERED_UNITS:
            self.pairs.clear()
        known = self.pairs[before, token] = self.parted(before, token) if before else len(token) == 1 or token in self.made
        return known

    def parted(self, left: bytes, right: bytes) -> bool:
        limit = NEVER
        while True:
            if self.rank.get((left, right), NEVER) < limit:
                return False
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left and (not made_right or made_left[0] > made_right[0]):
                limit, left = made_left[0], made_left[2]
            elif made_right:
                limit, right = made_right[0] + 1, made_right[1]
            else:
                return True

    def piece(self, word: bytes) -> list[int]:
        """Token counts at every byte prefix of one pre-token, from 0 bytes to all."""
        last, count, tokens, pairs = [b""], [0], self.tokens, self.pairs
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = word[start:end]
                if token in tokens:
                    before = last[start]
                    fits = pairs.get((before, token))
                    if fits or fits is None and self.follows(before, token):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return count

    def chars(self, text: str) -> list[int]:
        """The same at code points."""
        count = self.piece(text.encode())
        if len(count) == len(text) + 1:
            return count[1:]
        ends = np.cumsum([len(c.encode()) for c in text])
        return [count[e] for e in ends]

    def unit(self, unit: str) -> tuple[bytes, int]:
        """Differences of successive counts, one signed byte a code point, and the unit's tokens."""
        if unit[0] not in WHITE or unit[0] == " " and unit[1:2] not in WHITE:  # no white space but one plain space
            counts = self.chars(unit)
            if unit in CONTRACTIONS:  # cut short, these are an apostrophe and a letter
                counts[1] = 2
            return self.steps(counts), counts[-1]
        run = BODY.match(unit).group()
        body = unit[len(run) :]
        counts = self.chars(run) if run else []
        if body:
            glued = run[-1:] == " "  # a plain space goes with the body; other white space stays a token of its own
            before = (counts[-2] if len(run) > 1 else 0) if glued else (counts[-2] if len(run) > 1 else 0) + (self.chars(run[-1])[0] if run else 0)
            inner = self.chars(" " + body)[1:] if glued else self.chars(body)
            if not glued and body in CONTRACTIONS:
                inner[1] = 2
            counts = counts + [before + c for c in inner]
        return self.steps(counts), counts[-1]

    @staticmethod
    def steps(counts: list[int]) -> bytes:
        return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])

    def solved_units(self, units: set[str]) -> dict[str, tuple[bytes, int]]:
        """Solutions of units; those without white space but one plain space are solved together by length."""
        found, by_size = {}, {}
        for u in units:
            word = u.encode()
            if u in CONTRACTIONS or len(word) >= LONG or u[0] in WHITE and (u[0] != " " or u[1:2] in WHITE):
                found[u] = self.unit(u)
            else:
                by_size.setdefault(len(word), []).append((u, word))
        for n, rows in by_size.items():
            for k in range(0, len(rows), 8192):
                part = rows[k : k + 8192]
                count = self.solve([w for _, w in part])
                steps = np.diff(count).astype(np.int8).tobytes()
                for j, (u, word) in enumerate(part):
                    if len(u) == n:
                        found[u] = (steps[j * n : (j + 1) * n], int(count[j, n]))
                    else:  # only the ends of code points
                        ends = [e for e in range(1, n + 1) if e == n or word[e] & 0xC0 != 0x80]
                        counts = count[j, ends].tolist()
                        found[u] = (self.steps(counts), counts[-1])
        return found

    @staticmethod
    def keys(text: str) -> tuple[list[str], list[str]]:
        """A text as units, then words that each follow one plain space; units alone if words depend on each other."""
        if not text or RUN.search(text):
            return UNIT.findall(text), []
        first, *rest = text.split(" ")
        return UNIT.findall(first), rest

    def plain(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """Of texts in which no special token counts as one."""
        keys = [self.keys(t) for t in texts]
        words = set().union(*[x for _, x in keys])
        parts = {w: UNIT.findall(" " + w) for w in words if w not in self.words}
        units = set().union(*[x for x, _ in keys], *parts.values())
        new_units = self.solved_units({u for u in units if u not in self.units})
        new_words = {}
        for w, x in parts.items():
            found = self.looked_up(x, self.units, new_units)
            new_words[w] = found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), sum([f[1] for f in found]))
        out = []
        for own_units, own_words in keys:
            found = self.looked_up(own_units, self.units, new_units) + self.looked_up(own_words, self.words, new_words)
            out.append((b"".join([x[0] for x in found]), sum([x[1] for x in found])))
        for known, new in ((self.units, new_units), (self.words, new_words)):
            if len(known) < REMEMBERED_UNITS:
                known.update((u, x) for u, x in new.items() if len(u) < 100)
        return out

    @staticmethod
    def looked_up(keys: list[str], known: dict, new: dict) -> list[tuple[bytes, int]]:
        try:
            return [known[k] for k in keys]
        except KeyError:
            return [new[k] if k in new else known[k] for k in keys]

    def texts(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """For each text the differences of the counts at each code point, and its tokens."""
        special = [any(x in t for x in self.special) for t in texts]
        plain = iter(self.plain([t for t, s in zip(texts, special) if not s]))
        return [self.with_special(t) if s else next(plain) for t, s in zip(texts, special)]

    def with_special(self, text: str) -> tuple[bytes, int]:
        """Of one text that holds special tokens: each counts as one, and the text between them stands alone."""
        steps, total, at = b"", 0, 0
        for m in regex.finditer("|".join(map(regex.escape, self.special)), text):
            # until its last character, the string is ordinary text
            (inner, _), (_, whole) = self.plain([text[at : m.end() - 1], text[at : m.start()]])
            steps += inner + bytes([(whole + 1 - sum(np.frombuffer(inner, np.int8).tolist())) & 255])
            total += whole + 1
            at = m.end()
        inner, rest = self.plain([text[at:]])[0]
        return steps + inner, total + rest


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def longest_prefix(steps: bytes, budget: int) -> int:
    """The code points of the longest prefix that has at most budget tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, steps: for each document the token count at every prefix.

    ``steps`` holds one signed byte a code point; the count at a prefix of k code points is the
    sum of the first k.  ``path`` is a vocabulary file that every worker can read. With a budget of tokens,
    fits is added: the code points of the longest prefix within it.
    """
    names = ["doc_id", "n_bytes", "n_chars", "n_tokens", "steps"] + ["fits"] * (budget is not None)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path).texts
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(1)
            got = of(texts.to_pylist())
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            more = [] if budget is None else [pa.array([len(g[0]) if g[1] <= budget else longest_prefix(g[0], budget) for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.binary()), *more], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(solve, "doc_id long, n_bytes long, n_chars long, n_tokens long, steps binary" + ", fits long" * (budget is not None))


def tokens_at(steps: Column, n_chars: Column) -> Column:
    """The token count of the prefix of n_chars code points (null beyond the text)."""

    @F.pandas_udf("long")
    def at(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(b, np.int8)[: int(k)].sum(dtype=np.int64)) if b is not None and pd.notna(k) and 0 <= k <= len(b) else None for b, k in zip(s, n)], dtype="Int64")

    return at(steps, n_chars)


def truncate_to(steps: Column, budget: int) -> Column:
    """The code points of the longest prefix that has at most budget tokens."""

    @F.pandas_udf("long")
    def longest(s: pd.Series) -> pd.Series:
        return pd.Series([longest_prefix(b or b"", budget) for b in s], dtype="int64")

    return longest(steps)
