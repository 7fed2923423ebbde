"""Headings of sections: whose compounds they introduce, and in which role. A number alone introduces nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers as N
from .identifiers import NARROW, PRINTED, WIDE, identifier_key

#: Paragraph numbers, role words, titles of assays and preparations, and what joins the members of a group.
LOCATOR = r"(?:\[\s*\d{1,8}\s*\]|［\s*\d{1,8}\s*］)"
INTERMEDIATE_CJK = r"(?:中间体|中間体|中間體)"
SINGULAR, PLURAL, EITHER = rf"(?:Intermediate|{INTERMEDIATE_CJK})", rf"(?:Intermediates|{INTERMEDIATE_CJK})", rf"(?:Intermediates?|{INTERMEDIATE_CJK})"
ASSAY_TITLE = r"\bassay\b|\bbiological\s+(?:evaluation|assessment|activity|testing)\b|\b(?:HTRF|HiBiT|NanoBiT|FACS|pharmacokinetics?|pharmacokinetic)\b|\bin\s+vivo\s+(?:efficacy|evaluation|study|activity)\b|\b(?:cell|cellular)\s+(?:proliferation|viability|degradation)\b|生物(?:评价|评估|实验|活性)|药代(?:动力学|研究)|活性测定"
PREPARATION = r"^(?:Synthesis|Preparation|制备|合成)(?:\b|(?=[一-鿿]))"
SEPARATOR = r"\s*(?:,\s*(?:and\s+)?|and\s+|&\s*|和|及|、)\s*"
GOING_ON = r"^[.:：)]?\s*(?:and\b|to\s+\d|through\b|及|和)"
#: Members of one heading, and characters of a line that can be one.
MEMBERS, LONGEST = 32, 4096

FLAGS = "(?iU)"
OPENING = rf"^(?:{LOCATOR}\s*)?((?:(?:Synthesis|Preparation)\s+(?:of\s+)?)?)(?:Exemplary\s+)?"
HEADING = rf"{FLAGS}{OPENING}(Compound|Cmpd|Cpd|Example|{SINGULAR}|实施例|化合物)\s*[-:.：]?\s*({PRINTED})(?![\w/-])(.*)$"
GROUP = rf"{FLAGS}{OPENING}(Compounds|Cmpds|Cpds|Examples|{PLURAL}|实施例|化合物)\s*[-:.：]?\s*({PRINTED}(?:{SEPARATOR}{PRINTED}){{1,{MEMBERS - 1}}})(?![\w/-])(.*)$"
INTERMEDIATE_TARGET = rf"{FLAGS}^(?:(?:Synthesis|Preparation|制备|合成)\s*(?:of\s+)?)?{SINGULAR}(?=[\s:.：0-9-]|$)"
ROLE_TITLE = rf"{FLAGS}^(?:{LOCATOR}\s*)?(?:((?:(?:Synthesis|Preparation|制备|合成)\s*(?:of\s+)?)?{EITHER}[.:：]?)|(?:{ASSAY_TITLE}))(?:\s+(.+))?$"


def section_heading(text: Column) -> Column:
    """(members, kind, role, boundary) of a line that is a heading; null for any other line.

    members: the identifiers of the compounds, each as printed in the line; a range names none between its ends and is no heading. kind: the
    label's word in small letters. role: compound_heading, intermediate_section, assay_section, or ambiguous_heading where a title says both
    assay and preparation; too_many_members for a group beyond MEMBERS. boundary: whether it opens a procedure or an assay. What follows the
    identifier must begin a title, so prose that names a compound is no heading.
    """
    raw = F.trim(F.coalesce(text, F.lit("")))
    source = F.trim(F.regexp_replace(F.translate(raw, WIDE, NARROW), r"(?U)\s+", " "))
    fits = lambda x: x.rlike(GROUP) | x.rlike(HEADING)

    def of_source(s: Column) -> Column:
        inner = F.trim(F.regexp_extract(s, ROLE_TITLE, 2))
        titled = F.regexp_extract(s, ROLE_TITLE, 1) != ""
        body = F.struct(F.when(fits(s), s).when(s.rlike(ROLE_TITLE) & fits(inner), inner).alias("t"), F.when(~fits(s), F.when(titled, "intermediate_section").otherwise("assay_section")).alias("prefix"), s.alias("s"))
        return N.let(body, of_body)

    return F.when((F.length(raw) <= LONGEST) & (raw != ""), N.let(source, of_source))


def of_body(b: Column) -> Column:
    group = b["t"].rlike(GROUP)
    part = lambda k: F.when(group, F.regexp_extract(b["t"], GROUP, k)).otherwise(F.regexp_extract(b["t"], HEADING, k))
    found = F.struct(group.alias("group"), (part(1) != "").alias("preparation"), F.lower(part(2)).alias("kind"), part(3).alias("members"), F.trim(part(4)).alias("tail"), b["prefix"].alias("prefix"), b["s"].alias("s"))
    return F.when(b["t"].isNotNull(), N.let(found, of_parts))


def of_parts(p: Column) -> Column:
    tail, kind = p["tail"], F.when(p["group"], F.regexp_replace(p["kind"], "s$", "")).otherwise(p["kind"])
    title = F.regexp_replace(tail, r"^[.:：) ]+", "")
    has = lambda c, pattern: c.rlike(FLAGS + pattern)
    titled = (tail == "") | tail.rlike(r"^[.:：)]") | has(tail, PREPARATION) | has(tail, rf"^(?:{ASSAY_TITLE})")
    example = kind.isin("example", "实施例")
    prepares = p["preparation"] | has(title, PREPARATION)
    own = (
        F.when(has(kind, rf"^{EITHER}$") | (example & title.rlike(INTERMEDIATE_TARGET)), "intermediate_section")
        .when(example & has(title, ASSAY_TITLE), F.when(prepares, "ambiguous_heading").otherwise("assay_section"))
        .otherwise("compound_heading")
    )
    torn = (~own.isin("compound_heading") & (own != p["prefix"])) | ((p["prefix"] == "assay_section") & prepares)
    role = F.when(p["prefix"].isNull(), own).when(torn, "ambiguous_heading").otherwise(p["prefix"])
    members = F.when(p["group"], F.transform(F.split(p["members"], FLAGS + SEPARATOR, -1), identifier_key)).otherwise(F.array(identifier_key(p["members"])))
    more = p["group"] & has(tail, rf"^{SEPARATOR}{PRINTED}")
    located = F.regexp_replace(p["s"], rf"^{LOCATOR}\s*", "")
    boundary = prepares | (p["prefix"].isNotNull() & has(located, PREPARATION)) | (role == "assay_section")
    made = lambda role, members, boundary: F.struct(members.alias("members"), kind.alias("kind"), role.alias("role"), boundary.alias("boundary"))
    refused = made(F.lit("too_many_members"), F.array().cast("array<string>"), F.lit(False))
    sound = titled & ~has(tail, GOING_ON) & ~F.exists(members, lambda m: m == "")
    return F.when(more, refused).when(sound, made(role, members, boundary))


def heading_members(lines: DataFrame, keys: list[str], line: str, text: str) -> DataFrame:
    """(keys, line, place, identifier, kind, role, boundary): a row for each member of each heading among lines."""
    read = lines.select(*keys, line, section_heading(F.col(text)).alias("__h")).where("__h is not null")
    return read.select(*keys, line, F.posexplode("__h.members").alias("place", "identifier"), "__h.kind", "__h.role", "__h.boundary")
