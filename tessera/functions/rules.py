"""Rules on names, units and page text. Patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONCENTRATIONS = ("m", "mm", "um", "nm", "pm", "fm")
POTENCY = r"(?<!\w)(p?)(?:(?:ic|ec|dc|ac|gi|xc)[ _-]*(?:20|30|50|80|90|95)|k[ _-]*[id])(?!\w)"
DERIVED = r"\blog(?:10)?\b|\bratio\b|\bfold\b|\bselectivity\b|\bdifference\b"
DIMENSIONLESS = ("", "1", "-", "unitless", "dimensionless", "ratio")
ACTIVITY = r"(?i)IC50|DC50|EC50|(?<![A-Za-z])Ki\b|(?<![A-Za-z])Kd\b|Dmax|(?-i:(?<![A-Za-z])[nµμu]M(?![A-Za-z]))|GI50|CC50|pIC50|抑制率|结合率|降解率|表\s*\d|Table\s+\d.*activit"
SYNTHESIS = r"(?i)实施例\s*\d+|Example\s+\d+|合成例|制备例|MS\s*m/z|NMR|LCMS|HPLC|收率|产率|m\.p\.|Synthesis\s+of|Preparation\s+of|\bEx\.?\s*Structure\b|化合物编号|结构式|化学名称|LC-MS\s*$"
STRUCTURES = r"(?i)Compound\s*(?:No\.?|Number)\s*Structure|Structure\s*Chemical\s*Name|\bEx\.?\s*Structure\b|化合物编号|结构式|化学名称|LC-MS"
NON_CORE = r"(?im)权利要求|权利要求书|^What is claimed|BACKGROUND|SUMMARY|DRAWING|检索报告|PCT/ISA"
BIOASSAY = r"(?i)生物测试|测试例\s*\d+|Test\s*Example"
#: Prefixes of printed identifiers with their patterns; among equal counts the first wins.
PREFIXES = (("实施例", r"(?i)实施例\s*(\d+)"), ("化合物", r"(?i)化合物\s*(\d+)"), ("Cpd-", r"(?i)Cpd[-\s]?(\d+)"), ("Example", r"(?i)Example[-\s]+(\d+)"), ("Compound", r"(?i)Compound[-\s]+(\d+)"), ("Intermediate", r"(?i)Intermediate\s+(\d+)"))
#: Characters of a page that the rules see.
PAGE_WINDOW = 2400


def plain_unit(unit: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(unit, F.lit("")))), "µμ", "uu")


def is_concentration(unit: Column) -> Column:
    return plain_unit(unit).isin(*CONCENTRATIONS)


def direction(name: Column, unit: Column, assay: Column) -> Column:
    """(direction, rule): which way an endpoint improves, only where its name and unit say so."""
    label, u, a = F.lower(name), plain_unit(unit), F.lower(F.trim(F.coalesce(assay, F.lit(""))))
    answer = lambda d, r: F.struct(F.lit(d).alias("direction"), F.lit(r).alias("rule"))
    hits = F.regexp_count(label, F.lit(POTENCY))
    logarithm = F.regexp_extract(label, POTENCY, 1) == "p"
    bare, percent = u.isin(*DIMENSIONLESS), u.isin("%", "percent")
    effect, left = label.rlike(r"\binhibition\b|\bdegradation\b"), label.rlike(r"\bviability\b|\bremaining\b|\bresidual\b")
    ymin = label.rlike(r"\by[ _-]?min\b")
    dmax = label.rlike(r"\bd[ _-]?max\b")
    return (
        F.when((hits > 1) | ((hits == 1) & label.rlike(DERIVED)), answer("unknown", "ambiguous_endpoint"))
        .when((hits == 1) & logarithm & bare, answer("higher", "log_potency"))
        .when((hits == 1) & ~logarithm & ((u == "") | u.isin(*CONCENTRATIONS)), answer("lower", "potency"))
        .when(hits == 1, answer("unknown", "unit_conflict"))
        .when(ymin & (bare | percent) & F.concat(label, F.lit(" "), a).rlike("prolif|degrad"), answer("lower", "ymin_remaining"))
        .when(ymin, answer("unknown", "unknown_ymin_context_or_unit"))
        .when(dmax & (bare | percent), answer("higher", "effect_percent"))
        .when(dmax, answer("unknown", "unit_conflict"))
        .when(bare & label.rlike(r"\bhtrf\s+ratio\b") & (a == "htrf"), answer("lower", "htrf_competition"))
        .when(percent & effect & ~left, answer("higher", "effect_percent"))
        .when(percent & left & ~effect, answer("lower", "remaining_percent"))
        .otherwise(answer("unknown", "unknown"))
    )


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def page_signals(text: Column) -> dict[str, Column]:
    """What the page rules count and decide, on the first PAGE_WINDOW characters of a page."""
    t = F.left(F.coalesce(text, F.lit("")), F.lit(PAGE_WINDOW))
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    masses = hits(t, r"\b\d{3}\.\d\b")
    ids = hits(t, r"(?:^|\n)\s*\d{1,3}(?=\s|$)")
    line_ids = F.size(F.filter(lines, lambda x: x.rlike(r"^\d{1,3}\b")))
    line_masses = F.size(F.filter(lines, lambda x: x.rlike(r"\b\d{3}\.\d\b")))
    named = hits(t, r"化合物\s*\d+")
    names = hits(t, r"(?i)哌啶|吡啶|苯基|噻吩|呋喃|二酮|恶唑|噻唑|phenyl|pyrid|thien|furyl|piperid|dione|oxazol|thiazol")
    flat_ids = hits(t, r"(?s)(?<![\dA-Za-z.-])\d{1,4}(?![\dA-Za-z.-])(?=.{0,240}?\b\d{3}\.\d\b)")
    flat = (flat_ids >= 3) & (masses >= 3) & (names >= 2)
    dense = hits(t, r"(?i)Cpd[-\s]?\d+|实施例\s*\d+")
    activity = t.rlike(ACTIVITY)
    table = t.rlike(STRUCTURES)
    continuation = (((ids >= 3) & (masses >= 3)) | ((line_ids >= 3) & (line_masses >= 3)) | ((named >= 2) & (line_masses >= 2)) | flat) & ~activity
    return {
        "activity": activity | ((dense >= 10) & (hits(t, r"\b\d{1,5}\b") >= dense * 2)),
        "synthesis": t.rlike(SYNTHESIS) | (table & ((named >= 2) | (hits(t, r"\b\d+(?:\.\d+)?\b") >= 6))) | continuation,
        "table": table,
        "blank": F.trim(t) == "",
        "stops": t.rlike(NON_CORE) | t.rlike(BIOASSAY),
        "continues": ((ids >= 2) & (masses >= 2)) | ((line_ids >= 2) & (line_masses >= 2)) | ((named >= 2) & (masses >= 2)) | (flat & ~activity),
    }
