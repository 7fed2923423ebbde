"""Weighted scores; weights and bands are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import let

QUALITY = {"potency": 0.35, "coverage": 0.20, "admet": 0.20, "physchem": 0.15, "evidence": 0.10}
#: Property: weight, lower end, upper end, decay.
BANDS = {"molecular_weight": (0.20, 200, 550, 650), "logP": (0.25, 0, 4, 6), "tpsa": (0.20, 20, 140, 180), "hydrogen_bond_donors": (0.10, 0, 5, 10), "hydrogen_bond_acceptors": (0.10, 0, 10, 20), "solubility": (0.15, -3, 5, 7)}


def quality(parts: dict[str, Column]) -> Column:
    return sum((parts[k] * w for k, w in QUALITY.items()), F.lit(0.0))


def soft_band(value: Column, low: float, high: float, decay: float) -> Column:
    """100 inside the band, falling to 0 at the decay's distance."""
    return 100 * F.greatest(F.lit(0.0), 1 - F.greatest(low - value, value - high, F.lit(0.0)) / decay)


def desirability(properties: dict[str, Column]) -> Column:
    return sum((w * soft_band(properties[k], low, high, decay) for k, (w, low, high, decay) in BANDS.items()), F.lit(0.0))


def safety(risks: list[Column], absorption: list[Column], metabolism: list[Column]) -> Column:
    """Mean and worst protection count alike, so one strong liability shows."""
    kept = [1 - r for r in risks]
    mean = lambda c: sum(c, F.lit(0.0)) / len(c)
    return 100 * (0.6 * (0.5 * mean(kept) + 0.5 * F.least(*kept)) + 0.2 * mean(absorption) + 0.2 * mean([1 - m for m in metabolism]))


def confidence(parts: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Score 0.35/0.45/0.20 and its level at 0.7 and 0.4."""
    score = 0.35 * parts[0] + 0.45 * parts[1] + 0.20 * parts[2]
    return score, F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def character_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two strings' sets of characters."""
    chars = lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    union = F.size(F.array_union(chars(a), chars(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(chars(a), chars(b))) / union)


def engine_consensus(strings: Column) -> Column:
    """How far several engines' strings agree: 0.6 of the share of the most frequent one, 0.4 of the mean overlap of characters over all pairs.

    Strings under three characters count as no answer; one answer or none of several is worth 0.3, and a single engine 0.5.
    """
    known = F.filter(F.coalesce(strings, F.array().cast("array<string>")), lambda s: s.isNotNull() & (F.length(s) >= 3))

    def agreement(own: Column) -> Column:
        n = F.size(own)
        same = F.array_max(F.transform(own, lambda a: F.size(F.filter(own, lambda b: b == a)))) / n
        sets = F.transform(own, lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")))
        overlap = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
        later = lambda a, i: F.aggregate(F.slice(sets, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0.0), lambda t, b: t + overlap(a, b))
        total = F.aggregate(F.transform(sets, later), F.lit(0.0), lambda t, x: t + x)
        return F.least(F.lit(1.0), 0.6 * same + 0.4 * total / (n * (n - 1) / 2))

    answered = let(known, lambda own: F.when(F.size(own) <= 1, 0.3).otherwise(agreement(own)))
    return F.when(F.coalesce(F.size(strings), F.lit(0)) <= 1, 0.5).otherwise(answered)


def first_reason(reasons: list[tuple[Column, str]]) -> Column:
    """The first refusal that holds; null if none does."""
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in reasons], F.lit(None).cast("string"))
