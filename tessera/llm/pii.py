"""Personal data: exact patterns, and a linear-chain conditional random field that adds spans.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers with their checks.
The field reads white-space tokens by their shape, length and a few words, and those of both
neighbours; it is trained on a small labelled table (token, tag by sentence) by gradient ascent
on its likelihood, and decoded by Viterbi over numpy batches of token windows. Its spans stay
where no pattern's span lies; a kind that has a check must pass it. Every token of every line is
decoded, very long lines in blocks whose score matrices are chained (exactly, by max-plus products). All work
grows with the length of a text, whatever its characters and line breaks are.

Cases: a null text is empty and has no spans; an empty training table adds no spans; repeated
rows give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, slices

#: The kinds in their order and the patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ALL_KINDS = (*KINDS, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in ALL_KINDS for p in "BI"))
TOKEN = re.compile(r"\S+")
#: Characters before an at sign, and what must follow one; numbers joined by dots.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
REMEMBERED_TOKENS = 200_000
#: Tokens that are decoded at once.
DECODED = 30_000
#: Characters beyond which a line is decoded by itself, in blocks.
LONG_LINE = 1 << 16
#: Characters around a token that are not part of its value.
EDGES = "\"'`,;:!?<>[]{}*#$%&|=.()"


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def passes(kind: str, s: str) -> bool:
    """The check of a kind on the text of a span."""
    if kind == "email":
        return EMAIL.fullmatch(s) is not None
    if kind == "ip":
        return IP.fullmatch(s) is not None and all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))
    if kind == "card":
        d = digits_of(s)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(digits_of(s)) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What EMAIL finds, from the at signs outward: before one stand its address letters, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start, last = at, max(done, text.rfind("@", done, at) + 1)
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def dotted(text: str) -> Iterator[tuple[int, int]]:
    """What IP finds: each four numbers of a run of numbers joined by dots."""
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            yield start, start + size
            start += size + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all pattern matches that pass, by start and kind."""
    found = [(a, b, "email") for a, b in emails(text)]
    if "." in text:
        found += [(a, b, "ip") for a, b in dotted(text) if passes("ip", text[a:b])]
    found += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if passes("card", m.group())]
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if passes("phone", m.group())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> str:
    """Runs of capitals, small letters and digits as X, x and d; digits with their number up to four.

    Of a token with very many runs, the first and the last eight, and about how many there are.
    """
    runs = re.findall(r"[A-Z]+|[^\W\d_A-Z]+|[0-9]+|.", token)
    of = lambda s: f"d{min(5, len(s))}" if s[0].isdigit() else "X" if "A" <= s[0] <= "Z" else "x" if s[0].isalpha() else s
    if len(runs) > 16:
        return "".join(map(of, runs[:8])) + f"~{len(runs).bit_length()}~" + "".join(map(of, runs[-8:]))
    return "".join(map(of, runs))


class Forms(dict):
    """For str.translate: letters and digits by their class, so that tokens of one form share their traits."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "0" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "é" if c.isalpha() else c
        return self[code]


FORMS = Forms()
HEX = re.compile(r"[0-9a-fA-F]+")


def traits(token: str) -> list[str]:
    """What the field sees of a token: its form, whether it is hexadecimal, and the word itself."""
    core = token.strip(EDGES)
    return [*form_traits(token.translate(FORMS), HEX.fullmatch(core) is not None), "word:" + core.lower()]


def form_traits(token: str, is_hex: bool) -> list[str]:
    core = token.strip(EDGES)
    kinds = "".join(k for k, p in (("d", "[0-9]"), ("a", "[A-Za-z]"), ("@", "@"), (".", r"\."), ("-", "-"), ("+", r"\+"), ("(", r"\(")) if re.search(p, core or token))
    hexed = "hex" if is_hex else "alnum" if re.fullmatch(r"[0-9A-Za-z_+/=-]+", core) else "mixed"
    size = min(10, len(core) // 4)
    turns = min(6, len(re.findall(r"[A-Z]+|[^\W\d_A-Z]+|[0-9]+", core)) // 3)
    return ["shape:" + shape(token), "core:" + shape(core), f"turns:{turns}:{min(3, len(core) // 12)}", f"kinds:{kinds}", f"size:{size}", f"{hexed}:{size}:{kinds}"]


@dataclass
class Field:
    """Weights of traits for a token's own tag and its neighbours', and of tag pairs."""

    rows: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def __post_init__(self):
        self.number: dict[str, int] = {}
        self.known: dict[tuple[str, bool, int], int] = {}
        self.matrix = np.zeros((1024, 3 * len(TAGS)))

    def token_rows(self, tokens: list[str]) -> np.ndarray:
        """Own, before and after scores of each token, from what the worker remembers."""
        if max(len(self.number), len(self.known)) > REMEMBERED_TOKENS:
            self.number.clear()
            self.known.clear()
        for t in set(tokens):
            if t not in self.number:
                core = t.strip(EDGES)
                key = (t.translate(FORMS), HEX.fullmatch(core) is not None, self.rows.get("word:" + core.lower(), -1))
                if key not in self.known:
                    k = self.known[key] = len(self.known)
                    if k >= len(self.matrix):
                        self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                    ids = [self.rows[x] for x in form_traits(*key[:2]) if x in self.rows] + [key[2]] * (key[2] >= 0)
                    self.matrix[k] = np.concatenate([self.own[ids].sum(0), self.before[ids].sum(0), self.after[ids].sum(0)])
                self.number[t] = self.known[key]
        return self.matrix[[self.number[t] for t in tokens]]

    def emissions(self, tokens: list[str], ends: np.ndarray) -> np.ndarray:
        """Tag scores of concatenated lines; ends: where each line ends."""
        n, rows = len(TAGS), self.token_rows(tokens)
        own, before, after = rows[:, :n].copy(), rows[:, n : 2 * n], rows[:, 2 * n :]
        inner = np.ones(len(tokens), bool)
        inner[ends - 1] = False
        has_next = np.flatnonzero(inner)
        own[has_next + 1] += before[has_next]
        own[has_next] += after[has_next + 1]
        return own


def allowed() -> np.ndarray:
    """0 for pairs of tags that can follow each other; an inner tag needs its kind before it."""
    barred = np.zeros((len(TAGS), len(TAGS)))
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            for i, s in enumerate(TAGS):
                if s[2:] != t[2:]:
                    barred[i, j] = -1e9
    return barred


def viterbi(scores: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of concatenated windows, all windows of a batch step by step together."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    best = scores[starts].copy()
    best[:, [k for k, t in enumerate(TAGS) if t[0] == "I"]] = -1e9
    back = np.zeros((len(scores), len(TAGS)), np.int8)
    tags = np.zeros(len(scores), np.int8)
    last = np.zeros((len(starts), len(TAGS)))
    last[:] = best
    for step in range(1, int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, "left"))
        total = last[:live, :, None] + moves[None]
        at = starts[:live] + step
        back[at] = total.argmax(axis=1)
        last[:live] = total.max(axis=1) + scores[at]
    now = last.argmax(axis=1)
    for step in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        live = int(np.searchsorted(-sizes, -step, "left"))
        at = starts[:live] + step
        tags[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return tags


def viterbi_by_blocks(n: int, scores: Callable[[int, int], np.ndarray], moves: np.ndarray, length: int = 256, together: int = 128) -> np.ndarray:
    """The best tags of one window of n tokens, as ``viterbi`` finds them, in blocks; scores gives those of tokens a to b.

    A block's matrix holds the best score from the tag before it to the tag at its end; matrices of many blocks are made
    together, chained, and then the blocks are decoded from the scores before them, the last ones first. Only what
    ``together`` blocks need is held.
    """
    tags = np.zeros(n, np.int8)
    groups = [(a, min(together, (n - a) // length), length) for a in range(1, n - length + 1, length * together)]
    upto = 1 + (n - 1) // length * length
    groups += [(upto, 1, n - upto)] * (upto < n)
    now = scores(0, 1)[0] + np.array([-1e9 if t[0] == "I" else 0.0 for t in TAGS])
    entries = []
    for a, blocks, size in groups:
        s = scores(a, a + blocks * size).reshape(blocks, size, -1)
        best = moves[None] + s[:, 0, None, :]
        for t in range(1, size):
            best = (best[:, :, :, None] + moves).max(axis=2) + s[:, t, None, :]
        before = np.empty((blocks, len(TAGS)))
        for k in range(blocks):
            before[k] = now
            now = (now[:, None] + best[k]).max(axis=0)
        entries.append(before)
    end = int(now.argmax())
    for (a, blocks, size), last in zip(reversed(groups), reversed(entries)):
        s = scores(a, a + blocks * size).reshape(blocks, size, -1)
        back = np.empty((size, blocks, len(TAGS)), np.int8)
        for t in range(size):
            total = last[:, :, None] + moves
            back[t] = total.argmax(axis=1)
            last = total.max(axis=1) + s[:, t]
        ways = np.empty_like(back)
        now = np.tile(np.arange(len(TAGS)), (blocks, 1))
        for t in range(size - 1, -1, -1):
            ways[t] = now
            now = np.take_along_axis(back[t], now, 1)
        for k in range(blocks - 1, -1, -1):
            tags[a + k * size : a + (k + 1) * size] = ways[:, k, end]
            end = int(now[k, end])
    tags[0] = end
    return tags


def labelled_table(spark: SparkSession) -> DataFrame:
    """The small training table (sentence, position, token, tag): made from a few written forms by a fixed rule."""
    rows = [(s, p, t, g) for s, sentence in enumerate(written_sentences()) for p, (t, g) in enumerate(sentence)]
    return spark.createDataFrame(rows, "sentence int, position int, token string, tag string")


def written_sentences(n: int = 600, seed: int = 7) -> list[list[tuple[str, str]]]:
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    turned = lambda w: r.choice([w, w, w, w.capitalize(), w.upper(), w + "-" + w[::-1], w.capitalize() + w[:2].upper()])
    plain = lambda: turned(some("abcdefghijklmnopqrstuvwxyzéäñ", r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 18]))) + r.choice(["", "", "", ",", ".", "!!", "?", ":", "***", "%%%", "&&&"]) if r.random() < 0.95 else r.choice(["|", "###", "-", "--", "$$$", "=", "...", "<b>", "•"])

    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def phone():
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}"])

    def card():
        d = number(15)
        d += next(str(k) for k in range(10) if luhn(d + str(k)))
        return r.choice([d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4))])

    made = {
        "email": lambda: f"{some('abcdefgh', 5)}.{number(2)}@{some('mnop', 4)}{number(1)}.example.{r.choice(['com', 'org'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
        "secret": lambda: r.choice([some("0123456789abcdef", r.randint(26, 64)), some("0123456789abcdef", r.choice([32, 40, 64])), some("0123456789ABCDEF", r.randint(26, 64)), "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "sk-" + some("abcdefghijklmnopqrstuvwxyz0123456789", 32), some(mixed, r.randint(18, 44)) + number(2), some(mixed, r.randint(16, 30))]),
    }
    leads = {"email": ["mail", "contact", ""], "ip": ["host", "from", ""], "card": ["card", "paid", ""], "phone": ["call", "tel", "phone", ""], "secret": ["token =", "key:", "auth =", "access:", "TOKEN =", "credential =", "pwd:", ""]}
    other = [lambda: number(r.randint(1, 9)), lambda: number(16), lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: "$" + number(3) + "." + number(2), lambda: f"{number(1)}.{number(1)}.{number(1)}", lambda: number(2) + "%", lambda: some("abc", 3) + number(2), lambda: "@" + some("abcdef", 5), lambda: f"CC-BY-{number(1)}.0", lambda: some("abcdefgh", 12) + number(1), lambda: "www." + some("abcdefgh", 6) + ".org", lambda: "https://" + some("abcdefgh", 8) + ".com/" + some("abc", 4)]
    sentences = []
    for _ in range(n):
        sentence = [(plain(), "O") for _ in range(r.randint(1, 6))]
        for _ in range(r.randint(0, 2)):
            if r.random() < 0.5:
                kind = r.choice(list(made))
                sentence += [(w, "O") for w in r.choice(leads[kind]).split()]
                value = made[kind]()
                value = f'"{value}"' if kind == "secret" and r.random() < 0.5 else value + r.choice(["", "", ",", "."])
                value = r.choice(["auth=", "key=", "pass:", "id="]) + value if kind == "secret" and r.random() < 0.2 else value
                sentence += [(w, ("I-" if k else "B-") + kind) for k, w in enumerate(value.split(" "))]
            else:
                sentence.append((r.choice(other)() + r.choice(["", "", ",", "."]), "O"))
            sentence += [(plain(), "O") for _ in range(r.randint(1, 5))]
        sentences.append(sentence)
    return sentences


def fit(table: DataFrame, max_tokens: int = 200_000, rounds: int = 120, decay: float = 1e-3) -> Field:
    """Train on a labelled table of at most max_tokens rows (more are refused)."""
    got = table.select("sentence", "position", "token", "tag").where("token is not null and tag is not null").limit(max_tokens + 1).collect()
    if len(got) > max_tokens:
        raise ValueError(f"the labelled table has more than {max_tokens} tokens")
    got = sorted((r["sentence"], r["position"], r["token"], r["tag"]) for r in got)
    number = {t: k for k, t in enumerate(TAGS)}
    names: dict[str, int] = {}
    lists = [[names.setdefault(x, len(names)) for x in traits(t)] for _, _, t, _ in got]
    tags = np.array([number[g] for *_, g in got], np.int64)
    ends = np.array([k + 1 for k in range(len(got)) if k + 1 == len(got) or got[k + 1][0] != got[k][0]], np.int64)
    field = Field(names, *(np.zeros((len(names), len(TAGS))) for _ in range(3)), allowed())
    return ascend(field, lists, tags, ends, rounds, decay) if got else field


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradient(weights: list[np.ndarray], traits_of: np.ndarray, tags: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Of the log-likelihood of the tags, for each of the weights; forward and backward sums over all sentences together."""
    n, wide = traits_of.shape
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    inside = np.array([t[0] == "I" for t in TAGS])
    follows = np.setdiff1d(np.arange(n), starts)  # tokens that have one before
    score = weights[0][traits_of].sum(axis=1)
    score[follows] += weights[1][traits_of[follows - 1]].sum(axis=1)
    score[follows - 1] += weights[2][traits_of[follows]].sum(axis=1)
    moves = weights[3] + allowed()
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[starts] = score[starts] + np.where(inside, -1e9, 0)
    top = int(sizes[0])
    for s in range(1, top):
        at = starts[: int(np.searchsorted(-sizes, -s, "left"))] + s
        ahead[at] = logsum(ahead[at - 1][:, :, None] + moves[None], 1) + score[at]
    for s in range(top - 2, -1, -1):
        at = starts[: int(np.searchsorted(-sizes, -(s + 1), "left"))] + s
        behind[at] = logsum(moves[None] + (score[at + 1] + behind[at + 1])[:, None, :], 2)
    total = np.zeros(n)
    for a, z in zip(starts, sizes):
        total[a : a + z] = logsum(ahead[a + z - 1], 0)
    chance = np.exp(ahead + behind - total[:, None])
    joint = np.exp(ahead[follows - 1][:, :, None] + moves[None] + (score[follows] + behind[follows])[:, None, :] - total[follows][:, None, None]).sum(axis=0)
    pairs = np.zeros_like(moves)
    np.add.at(pairs, (tags[follows - 1], tags[follows]), 1)
    miss = np.eye(len(TAGS))[tags] - chance

    def shared(per_token: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros_like(weights[0])
        for k in range(wide):
            np.add.at(out, traits_of[rows, k], per_token)
        return out

    return [shared(miss, np.arange(n)), shared(miss[follows], follows - 1), shared(miss[follows - 1], follows), pairs - joint]


def ascend(field: Field, lists: list[list[int]], tags: np.ndarray, ends: np.ndarray, rounds: int, decay: float) -> Field:
    """Adam on the regularised log-likelihood."""
    weights = [field.own, field.before, field.after, np.zeros((len(TAGS), len(TAGS)))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        for k, g in enumerate(gradient(weights, np.array(lists), tags, ends)):
            g = g / len(ends) - decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] += 0.2 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return Field(field.rows, *weights[:3], weights[3] + allowed())


def places(text: str, a: int, b: int) -> np.ndarray:
    """(start, end) of each token between a and b."""
    return np.fromiter((x for m in TOKEN.finditer(text, a, b) for x in m.span()), np.int64).reshape(-1, 2)


def long_line(field: Field, text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' places and tags of one line, in blocks."""
    spans = places(text, a, b)

    def scores(i: int, j: int) -> np.ndarray:
        before, after = max(0, i - 1), min(len(spans), j + 1)
        words = [text[x:y] for x, y in spans[before:after].tolist()]
        return field.emissions(words, np.array([len(words)]))[i - before : j - before]

    return spans, viterbi_by_blocks(len(spans), scores, field.moves) if len(spans) else np.zeros(0, np.int8)


def tagged_lines(field: Field, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, places of tokens, tags) of every line in which the field finds something; all lines are decoded, so many tokens at a time."""
    held: list[tuple[int, int, int, list[str]]] = []

    def decoded() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ends = np.cumsum([len(words) for *_, words in held])
        tags = viterbi(field.emissions([w for *_, words in held for w in words], ends), ends, field.moves)
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(tags), "right")):
            d, a, b, words = held[k]
            yield d, places(texts[d], a, b), tags[ends[k] - len(words) : ends[k]]

    size = 0
    for d, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            if len(line) > LONG_LINE:
                spans, tags = long_line(field, text, at, at + len(line))
                if tags.any():
                    yield d, spans, tags
            elif words := line.split():
                held.append((d, at, at + len(line), words))
                size += len(words)
                if size >= DECODED:
                    yield from decoded()
                    held, size = [], 0
            at += len(line) + 1
    if held:
        yield from decoded()


def added_spans(field: Field, texts: list[str], base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """For each text the spans that the field adds to the patterns' ones."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not field.rows:
        return out
    for d, w, own in tagged_lines(field, texts):
        for k in np.flatnonzero(own):
            if TAGS[own[k]][0] != "B":
                continue
            kind, e = TAGS[own[k]][2:], k + 1
            while e < len(w) and TAGS[own[e]] == f"I-{kind}":
                e += 1
            a, b = int(w[k, 0]), int(w[e - 1, 1])
            edges = EDGES.replace("(", "") if kind == "phone" else EDGES
            while a < b and texts[d][a] in edges:
                a += 1
            while a < b and texts[d][b - 1] in EDGES:
                b -= 1
            if a < b and passes(kind, texts[d][a:b]) and not any(a < y and x < b for x, y, _ in base[d]):
                out[d].append((a, b, kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], ALL_KINDS.index(s[2]))))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, end) in code points, ends exclusive, by start and kind."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            cells = lambda rows: pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in r] for r in rows], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), cells(base), cells(added_spans(field, texts, base))], ["doc_id", "base", "added"])

    one = "array<struct<kind: string, start: int, end: int>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(each, f"doc_id long, base {one}, added {one}")


def listed(spans: F.Column) -> F.Column:
    """Spans as kind:start:end by start, then kind as listed, joined by commas."""
    place = F.array(*[F.lit(k) for k in ALL_KINDS])
    rows = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(place, s["kind"]), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
