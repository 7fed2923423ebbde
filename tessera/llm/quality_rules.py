"""Quality rules as a learned decision list, in DataFrame operations alone.

Statistics of each text come from string and array functions. Sequential covering then learns
rules for label 0 from the labelled statistics: a rule grows by the threshold condition with
the best information gain (counts of each statistic's buckets by label, one grouped job a
step; only these counts reach the driver), is pruned on rows kept aside, and its rows leave
before the next rule. The list becomes an ordered chain of Spark conditions; what no rule
rejects is kept.

Words are runs of characters other than space and \\x09-\\x0D. A word counts as repeated when it
lies in a window of three words that the text has at least twice.

Cases: a null or empty text has no words and fails the base rule; without labelled rows no
rule is learned; a null label teaches nothing; repeated rows give repeated rows; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out

#: What separates words, and the symbols that are counted.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Statistics that rules may use, and how they follow from the counts.
SHARES = {
    "words": "n_words",
    "word_size": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}
#: Buckets of a statistic, at quantiles of the labelled rows.
BUCKETS = 24


def covered(places: Column) -> Column:
    """Words in the union of three-word windows at ascending places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules use, all long.

    Equal three-word windows have equal hashes, so texts whose hashes all differ repeat nothing.
    In the others, windows are sorted as strings; equal neighbours mark their places.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    removed = lambda marks: F.length("text") - F.length(F.translate("text", marks, ""))
    has_word = lambda line: F.translate(line, WHITE, "") != ""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n", -1), has_word).alias("lines"))
    words = F.col("words")
    at = lambda k: F.get(words, k)
    last = F.greatest(F.size("words") - 2, F.lit(0))
    hashes = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, at(i + 1), at(i + 2))), 1, last)
    rows = rows.select("*", F.size("words").alias("n"), hashes.alias("hashes"))
    windows = F.slice(F.transform("words", lambda w, i: F.struct(F.concat_ws(" ", w, at(i + 1), at(i + 2)).alias("w"), i.alias("i"))), 1, last)
    alike = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.select("*", F.when(alike, F.array_sort(windows)).alias("windows"))
    sorted_ = F.col("windows")
    same = lambda s, k: s["w"].eqNullSafe(F.get(sorted_, k)["w"])
    places = F.array_sort(F.transform(F.filter(sorted_, lambda s, i: same(s, i - 1) | same(s, i + 1)), lambda s: s["i"]))
    shouts = F.size(F.filter("words", lambda w: w.endswith("!") | ((F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))))
    found = {
        "n_words": F.col("n"),
        "word_chars": F.length(F.translate("text", WHITE, "")),
        "n_symbols": removed(SYMBOLS),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered(places), F.lit(0)),
        "n_capitals": removed(CAPITALS),
        "n_shouts": shouts,
        "n_digits": removed("0123456789"),
        "n_distinct": F.size(F.array_distinct("words")),
    }
    return rows.select("doc_id", *[c.cast("long").alias(k) for k, c in found.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """A statistic at most, or above, a threshold."""

    share: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(f"cast({SHARES[self.share]} as double)")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.share} {'>' if self.above else '<='} {self.threshold:.6g}"


def all_of(conditions: list[Condition]) -> Column:
    found = F.lit(True)
    for c in conditions:
        found = found & c.column()
    return found


def kept(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects; none keeps."""
    chain = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        chain = chain.when(all_of(rule), F.lit(False))
    return chain.otherwise(F.lit(True))


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Distinct quantiles of each statistic."""
    steps = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    row = rows.agg(*[F.percentile_approx(F.expr(f"cast({e} as double)"), steps, F.lit(10_000)).alias(k) for k, e in SHARES.items()]).first()
    return {k: sorted(set(row[k] or [])) for k in SHARES}


def best_condition(rows: DataFrame, cuts: dict[str, list[float]], covered_now: tuple[int, int]) -> tuple[float, Condition | None, tuple[int, int]]:
    """The condition of most FOIL gain for label 0 among the rows, with what it covers (label 0, label 1)."""
    buckets = [F.expr("size(filter(array({}), t -> t < cast({} as double)))".format(", ".join(f"{t!r}D" for t in cuts[k]), e)) if cuts[k] else F.lit(0) for k, e in SHARES.items()]
    found = rows.select("label", F.posexplode(F.array(*buckets)).alias("share", "bucket")).groupBy("share", "bucket", "label").count().collect()
    zero, one = covered_now
    start = math.log2(zero / (zero + one))
    best: tuple[float, Condition | None, tuple[int, int]] = (0.0, None, covered_now)
    for s, name in enumerate(SHARES):
        by = {(r["bucket"], r["label"]): r["count"] for r in found if r["share"] == s}
        below = [0, 0]
        for k, t in enumerate(cuts[name]):  # buckets up to k hold the values up to the threshold
            for label in (0, 1):
                below[label] += by.get((k, label), 0)
            for above, (p, n) in ((False, tuple(below)), (True, (zero - below[0], one - below[1]))):
                gain = p * (math.log2(p / (p + n)) - start) if p else 0.0
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, Condition(name, above, t), (p, n))
    return best


def by_label(rows: DataFrame) -> tuple[int, int]:
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    return found.get(0, 0), found.get(1, 0)


def pruned(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], float]:
    """The beginning of a rule that is best on rows it was not grown on, and its share of label 0 there."""
    sums = []
    for k in range(1, len(rule) + 1):
        for label in (0, 1):
            sums.append(F.count_if(all_of(rule[:k]) & (F.col("label") == label)).alias(f"c{k}_{label}"))
    row = rows.agg(*sums).first()
    worth = [((row[f"c{k}_0"] - row[f"c{k}_1"]) / max(1, row[f"c{k}_0"] + row[f"c{k}_1"]), -k) for k in range(1, len(rule) + 1)]
    k = -max(worth)[1]
    zero, one = row[f"c{k}_0"], row[f"c{k}_1"]
    return rule[:k], zero / (zero + one) if zero + one else 0.0


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality", max_rules: int = 8, max_conditions: int = 3, purity: float = 0.8, least_gain: float = 5.0) -> list[list[Condition]]:
    """An ordered list of rules for label 0, from counts (doc_id, ...) and labels of the rows that are not held out."""
    taught = labels.where(F.col(label).isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = cut(rows.join(taught, "doc_id").where(~base_failed()), "labelled")
    cuts = thresholds(known)
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    rules: list[list[Condition]] = []
    for _ in range(max_rules):
        open_ = known.where(kept(rules)) if rules else known
        grow, rule = open_.where(~aside), []
        cover = by_label(grow)
        while cover[0] and cover[1] and len(rule) < max_conditions:
            gain, condition, cover_next = best_condition(grow.where(all_of(rule)) if rule else grow, cuts, cover)
            if condition is None or gain < least_gain:
                break
            rule.append(condition)
            cover = cover_next
        if not rule:
            break
        rule, pure = pruned(open_.where(aside), rule)
        if pure < purity:
            break
        rules.append(rule)
    return rules


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, all counts, base_failed, kept: false where the base rule fails, else the decision list's verdict."""
    rows = cut(counts(docs, id_col, text_col), "counts")
    rules = learn(rows, labels, label)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & kept(rules))
