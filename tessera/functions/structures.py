"""What a page's text says of numbered structures. Patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_HEADER = r"(?i)化合物编号|化合物\s*(?:结构|列表)|结构式|化学结构|结构列表|结构表|\bcompounds?\s+(?:table|list)\b|\b(?:compound|cmpd)\s*(?:no\.?|number|id|#)\b|\b(?:compound|cmpd).{0,32}\b(?:structure|formula)\b|\b(?:structure|formula).{0,32}\b(?:compound|cmpd)\b"
ROW_ID = r"(?:^|\n)\s*\d{1,4}(?=\s|$)"
MASS = r"\b\d{3}\.\d\b"
FLAT_ID = r"(?s)(?<![\dA-Za-z.-])\d{1,4}(?![\dA-Za-z.-])(?=.{0,240}?\b\d{3}\.\d\b)"
CHEMICAL_NAME = r"(?i)哌啶|吡啶|苯基|噻吩|呋喃|二酮|恶唑|噻唑|phenyl|pyrid|thien|furyl|piperid|dione|oxazol|thiazol"
SERIES_ID = r"(?i)(?<![A-Za-z0-9])(?:[A-Z]|[1Il])\s*[-–—]\s*\d{1,5}(?!\d)"
ASSAY = r"(?i)\bSynthesized\s+in\b|\bHNMR\b|\bNMR\b|\bMS\s*\(\s*ESI|\bm/z\b|\bIC50\b|\bEC50\b|\bDC50\b|\bDmax\b|\bNanoBiT\b|\bHTRF\b"
STRUCTURE_COLUMN = r"(?i)\b(?:structure|formula)\b|结构式|化学结构|结构表"
NUMBER_COLUMN = r"(?i)化合物编号|\b(?:compound|cmpd|cpd)\s*(?:no\.?|number|id|#)\b"
ADJACENT = r"(?i)\b(?:compound|cmpd|cpd|example|intermediate)s?\s+(?:structures?|formulae?)\b|化合物\s*(?:结构|列表)|结构列表|结构表"
LABEL = r"(?i)\b(?:compound|cmpd|cpd|example|intermediate)\s*[-:]?\s*(?:[A-Z]\s*[-–—]\s*)?(?:\d+|[S$＄]\d+)(?:-\d+)?[A-Z]?(?![\w-])|(?:实施例|化合物|中间体|制备例|合成例)\s*(?:\d+|[S$＄]\d+)(?:-\d+)?[A-Z]?"
CHEMISTRY = r"(?i)\b(?:NMR|HNMR|LCMS|LC[-\s]?MS|HPLC|mmol|synthesis|preparation|purified|reagents?|stirred|stirring|dissolved|dissolving)\b|\bMS\s*(?:m/z|\(\s*ESI)|\bm/z\b|合成|制备|收率|产率|反应|纯化"
OTHER_SECTION = r"(?i)\bWhat\s+is\s+claimed\b|权利要求|\bBACKGROUND\b|\bSUMMARY\b|检索报告|PCT/ISA|生物测试|测试例\s*\d+|\bTest\s*Example\b"
ATOM = r"(?<![A-Za-z])(?:HN|NH|OH|HO|Cl|Br|[NOSFP])(?![A-Za-z])"
POINTED_ID = r"(?i)(?<![\w.])([1-9]\d{0,3}[A-Z]?)\.(?=\s|$)"
TABLE_INDEX = r"(?:[A-Za-z][-–—]?)?\d+(?:[-–—]\d+)*[A-Za-z]?"
TABLE_MARKER = rf"\bTab[li1]e(?:\s*{TABLE_INDEX}|\s+[A-Za-z])\b(?![-–—])|表\s*(?:{TABLE_INDEX}|[A-Za-z])(?![A-Za-z0-9–—-])"
CATALOGUE = rf"(?i)(?:{TABLE_MARKER})\s*[.:：]?\s*(?:(?:non[-\s]?limiting|exemplary)\s+)*(?:compounds?|structures?)\b(?:\s+(?:table|catalog|list))?"
SERIES_HEADER = r"(?is)(?:[A-Z]|[1Il])\s*-\s*#.{0,48}\bStructure\b|\bTable\s*\d+\s*[.:]?\s*(?:Exemplary\s+)?Compounds?\b"


#: White space, digits, letters and word edges are those of all scripts.
ALL_SCRIPTS = "(?U)"


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(ALL_SCRIPTS + pattern))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(ALL_SCRIPTS + pattern)


def compact_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def dense(text: Column) -> Column:
    """Six labels or more, with at most 50 characters for each."""
    labels = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ALL_SCRIPTS + LABEL), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", ""))))
    return (F.size(labels) >= 6) & (compact_length(text) <= F.size(labels) * 50)


def catalogue_entry(text: Column) -> Column:
    """Whether what follows a titled catalogue, up to the end, is dense and no assay."""
    titles, between = F.regexp_extract_all(text, F.lit(ALL_SCRIPTS + CATALOGUE), F.lit(0)), F.split(text, ALL_SCRIPTS + CATALOGUE, -1)
    ends = F.transform(titles, lambda t, i: F.aggregate(F.slice(F.zip_with(titles, between, lambda a, b: F.length(a) + F.length(b)), F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0))))
    below = lambda end: F.substring(text, end + 1, F.length(text))  # noqa: E731  one at a time
    return F.exists(ends, lambda e: dense(below(e)) & ~has(below(e), ASSAY))


def structure_signals(text: Column) -> dict[str, Column]:
    """seed: the evidence of a page by itself (table, caption or null); barrier, table_like and chemical: how it may continue a neighbour's."""
    t = F.coalesce(text, F.lit(""))
    assay, masses, series = has(t, ASSAY), hits(t, MASS), hits(t, SERIES_ID)
    entry, compact, names, atoms = catalogue_entry(t), compact_length(t), hits(t, CHEMICAL_NAME), hits(t, ATOM)
    ids = hits(t, ROW_ID)
    header = has(t, TABLE_HEADER)
    table_page = (
        entry
        | header
        | ((ids >= 3) & (masses >= 3))
        | ((hits(t, r"化合物\s*\d+") >= 2) & (masses >= 2))
        | (dense(t) & ~assay)
        | ((ids >= 8) & ~assay)
        | ((hits(t, FLAT_ID) >= 3) & (masses >= 3) & (names >= 2) & ~assay)
        | has(t, SERIES_HEADER)
        | ((series >= 2) & (compact <= 500))
        | ((series == 1) & (compact <= 100))
    )
    row_evidence = (series > 0) | (header & has(t, POINTED_ID))
    proved = (
        F.when(dense(t) & ~assay, True)
        .when(has(t, STRUCTURE_COLUMN), has(t, NUMBER_COLUMN) | (has(t, ADJACENT) & row_evidence))
        .when(assay, False)
        .otherwise((series > 0) | ((masses >= 2) & (names >= 2)) | (atoms >= 2))
    )
    table = entry | ((F.trim(t) != "") & table_page & proved)
    caption = has(t, LABEL) & ~has(t, OTHER_SECTION) & (has(t, CHEMISTRY) | (atoms >= 2))
    return {
        "seed": F.when(table, "table").when(caption, "caption"),
        "barrier": (t == "") | has(t, OTHER_SECTION),
        "table_like": ~assay & (hits(t, POINTED_ID) >= 2) & (atoms >= 2),
        "chemical": has(t, CHEMISTRY),
    }
