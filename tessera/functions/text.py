"""Text functions of exports, tables and headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let


def formula_safe(text: Column) -> Column:
    """A leading apostrophe where a spreadsheet would read a formula."""
    bare = F.ltrim(text, F.lit(" \t\r\n\x0b\f﻿"))
    return F.when(bare.rlike(r"^[=+\-@]") | text.rlike(r"^[\t\r\n]"), F.concat(F.lit("'"), text)).otherwise(text)


def tab_line(*cells: Column) -> Column:
    """Cells as one tab-separated line; tabs and line breaks inside a cell become spaces."""
    return F.concat_ws("\t", *[F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in cells])


def messages(texts: Column) -> Column:
    """Collapse white space, cut to 300 characters, drop repeats and blanks, keep twelve."""
    clean = F.transform(F.filter(texts, lambda x: F.trim(x) != ""), lambda x: F.left(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(300)))
    return F.slice(F.array_distinct(clean), 1, 12)


def casefold(text: Column) -> Column:
    """Full case folding; lower() suffices where text is ASCII."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.str.casefold()

    return fold(text)


#: The labels of experimental conditions, and what says that one is not known.
CONDITIONS = {
    "target": r"Target|靶点",
    "assay": r"Assay(?:[ \t]+name)?|实验方法|实验",
    "cell_line": r"Cell[ -]+line|细胞系|细胞株",
    "construct": r"Construct|构建体",
    "duration": r"Duration|处理时长",
    "treatment_duration": r"Treatment[ \t]+duration|处理持续时间",
    "timepoint": r"Time[ -]?point|时间点",
    "batch": r"Batch|批次",
}
UNKNOWN = ("", "unknown", "not recorded", "not specified")
LABEL = rf"(?iU)(?<![\w-])(?:{'|'.join(CONDITIONS.values())})[ \t]*[:：][ \t]*"


def conditions(text: Column) -> Column:
    """(values, conflicts) of the conditions that a text declares as "Label: value".

    A value goes on to the next label, semicolon or line break (one right behind the label is skipped); an unknown one is none. values maps each
    condition to its first value; a treatment's duration is the duration. conflicts names the conditions declared in two ways.
    """
    t = F.coalesce(text, F.lit(""))

    def entry(label: Column, content: Column) -> Column:
        field = F.coalesce(*[F.when(label.rlike(rf"(?iU)^(?:{p})[ \t]*[:：]"), k) for k, p in CONDITIONS.items()])
        value = F.btrim(F.get(F.split(F.regexp_replace(content, r"^\r?\n", ""), r"[;；\r\n]", 2), F.lit(0)), F.lit(" \t,"))
        return F.struct(F.when(field == "treatment_duration", "duration").otherwise(field).alias("key"), value.alias("value"))

    pieces = F.split(t, LABEL, -1)
    found = F.zip_with(F.regexp_extract_all(t, F.lit(LABEL), F.lit(0)), F.slice(pieces, F.lit(2), F.size(pieces)), entry)

    def sorted_out(known: Column) -> Column:
        keys = F.transform(known, lambda e: e["key"])
        firsts = F.filter(known, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
        values = F.map_from_entries(firsts)
        other = F.filter(known, lambda e: F.exists(firsts, lambda f: (f["key"] == e["key"]) & (f["value"] != e["value"])))
        return F.struct(values.alias("values"), F.array_sort(F.array_distinct(F.transform(other, lambda e: e["key"]))).alias("conflicts"))

    return let(F.filter(found, lambda e: ~F.lower(e["value"]).isin(*UNKNOWN)), sorted_out)


def section_role(heading: Column) -> Column:
    """What a heading opens: claims, bioassay, synthesis, background, or other."""
    h = F.lower(F.trim(heading))
    return F.when(h.rlike(r"what is claimed|^claims?\b|权利要求"), "claims").when(h.rlike(r"test example|biolog|assay|生物测试|测试例"), "bioassay").when(h.rlike(r"^example|synthesis|preparation|实施例|制备例"), "synthesis").when(h.rlike(r"background|summary|drawing|背景"), "background").otherwise("other")


def fixed(text: Column, rules: list[tuple[str, str, bool]]) -> Column:
    """Apply ordered (pattern, replacement, is_regex) corrections."""
    for pattern, replacement, is_regex in rules:
        text = F.regexp_replace(text, pattern, replacement) if is_regex else F.replace(text, F.lit(pattern), F.lit(replacement))
    return text


#: The characters of SMILES.
SMILES = r"^[a-zA-Z0-9\[\]()=#@+\-/\\.:%]*$"


def smiles_score(smiles: Column) -> Column:
    """0 to 1: how far a string's characters, brackets, dots, carbon and length are those of SMILES, without chemistry; under three characters 0."""
    s = F.coalesce(smiles, F.lit(""))
    unlike = lambda a, b: F.regexp_count(s, F.lit(a)) != F.regexp_count(s, F.lit(b))
    faults = [(~s.rlike(SMILES), 0.3), (unlike(r"\[", r"\]"), 0.3), (unlike(r"\(", r"\)"), 0.2), (s.contains(".."), 0.2), (s.startswith(".") | s.endswith("."), 0.1), (~s.rlike("[Cc]"), 0.2), ((F.length(s) < 5) | (F.length(s) > 500), 0.2)]
    score = F.lit(1.0)
    for fault, weight in faults:
        score = score - F.when(fault, weight).otherwise(0.0)
    return F.when(F.length(s) < 3, 0.0).otherwise(F.greatest(score, F.lit(0.0)))


#: How a table row writes one value: a number with its bound, range, uncertainty, comma or unit; a missing value; a grade.
PLAIN = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
EITHER = r"[+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?"
SPREAD = rf"(?:[<>≤≥]=?\s*)?{EITHER}%?\s*(?:±|\+/-)\s*[0-9]+(?:\.[0-9]+)?"
COMMA = r"(?:[<>≤≥]=?\s*)?[+-]?[0-9]+,[0-9]+(?:[eE][+-]?[0-9]+)?"
LITERAL = rf"(?:[\[(]\s*{PLAIN}\s*,\s*{PLAIN}\s*[\])]|{PLAIN}\s*(?:-|–|—|\.\.)\s*{PLAIN}|(?:<=|>=|<|>|≤|≥)\s*{PLAIN}|{PLAIN})"
MEASURED = rf"(?:{SPREAD}|{COMMA}|{LITERAL})(?:%|\s*(?:nM|uM|µM|μM|mM|pM|mg/kg|ng/mL|h|min))?"
UNMEASURED = r"not\s+tested|not\s+determined|not\s+available|未测试|未测定|未检测|N/?A|ND|NT|[-—–]|∞|[A-G](?:[12])?|\+{1,5}"
TOKEN = rf"(?>{MEASURED}|{UNMEASURED})"


def only_values(tail: Column) -> Column:
    """Whether everything in a row's tail is a value, as ``value_tokens`` reads it."""
    t = F.coalesce(tail, F.lit(""))
    return t.rlike(rf"(?i)^(?:[\s,;]*+{TOKEN}(?=\s|$))*+[\s,;]*+$") & ~t.rlike(r"[0-9][eE][+-]?0*[1-9][0-9]{3}")


def value_tokens(tail: Column) -> Column:
    """The values of a row's whole tail, in order; null if anything in it is no value, so prose gives none.

    A value ends at white space or the end; commas, semicolons and white space may stand before one. Exponents of
    four digits and more are out of range, so such a text has no values.
    """
    found = F.regexp_extract_all(F.coalesce(tail, F.lit("")), F.lit(rf"(?i)(?<=^|[\s,;]){TOKEN}(?=\s|$)"), F.lit(0))
    return F.when(only_values(tail), F.transform(found, lambda x: F.translate(F.trim(x), "＋％", "+%")))


def is_value(text: Column) -> Column:
    """Whether a cell holds one value as ``value_tokens`` reads it, and says something."""
    return F.trim(text).rlike(rf"(?i)^{TOKEN}$") & ~text.rlike(r"[0-9][eE][+-]?0*[1-9][0-9]{3}")


def decimal_comma(text: Column) -> Column:
    """Whether a source value is numeric once a decimal comma, uncertainty or percent sign is allowed for."""
    number = r"[+-]?(?:[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?"
    return F.trim(text).rlike(rf"^(?:[<>≤≥]=?\s*)?{number}%?(?:\s*(?:±|\+/-)\s*{number}%?)?$")
