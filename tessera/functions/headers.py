"""Headers of measurement columns: the metrics and units that they name, and the field that a column becomes.

Only typography is repaired, and only in a copy: the printed header stays the evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers as N

#: Endpoints that a label may touch, endpoints that stand alone, which of these have no unit, units, and glyphs.
JOINED = ("p?IC50", "EC50", "DC50", "GI50", "CC50")
ALONE = ("Ki", "Kd", "Imax", "Dmax", "Ymin", "Ymax", "Clint", "CL", "t1/2", "Cmax", "AUC(?:0?(?:-|–)?(?:t|inf))?", "TGI", "Dose", r"Tumou?r\s+volume", r"p\s*value", "Ratio", "Grade", "F")
UNITLESS = r"(?i)^(?:p\s*value|Ratio|Grade|Ymin|Ymax)$"
UNIT = r"(?:[fpnumµμ]?M|%|(?:[pnumµμ]?g)/(?:kg|[munµμ]?L)|(?:mL|L)/(?:min|h)(?:/kg)?|(?:mm|cm)(?:3|\^3)|h|min|s)"
UNIT_CHARACTERS = r"fpnumµμM%g/kLihsc3^"
GLYPHS, PLAIN = "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹（）", "01234567890123456789()"
#: Spellings with gaps that are read as one endpoint.
SPACED = ("pIC50", "IC50", "EC50", "DC50", "GI50", "CC50")
SPELLED = ("Ki", "Kd", "Imax", "Dmax", "Ymax", "Ymin", "Cmax", "Clint")
#: Headers of counts, which are no measurements.
COUNTS = {"n": "reported_n", "sample size": "sample_count", "number of samples": "sample_count", "样本数": "sample_count", "样本量": "sample_count", "replicates": "replicate_count", "number of replicates": "replicate_count", "no. of replicates": "replicate_count", "重复次数": "replicate_count", "重复数": "replicate_count"}
#: How headers of counts begin.
COUNTED = rf"(?iU)^\s*[{''.join(sorted({name[0] for name in COUNTS}))}]"

END = "(?![A-Za-z0-9])"
METRIC = rf"(?i)(?:(?:{'|'.join(JOINED)}){END}|(?<![A-Za-z0-9])(?:{'|'.join(ALONE)}){END})\s*(?:\([^)]*\)|（[^）]*）)?(?:\s+(?:grade|class))?"
#: What is left of a metric, or of what ``metric_text`` may turn into one, in small letters without gaps: texts without any of it name none.
POSSIBLE = r"c5[0o]|gi5[0o]|k[id]|max|ymin|cl|auc|t1/2|tgi|dose|volume|value|ratio|grade|f"
#: Characters of a header that a field's name may hold; longer ones stay evidence alone.
LONGEST = 200


def spaced(name: str) -> str:
    """A pattern of the name's characters with gaps; zero may be printed as the letter."""
    return r"[\s_]*".join("[0O]" if c == "0" else c for c in name)


def unit_of(text: Column) -> Column:
    """The unit, without white space, if the text is one whole unit within optional brackets; else null. Texts with other characters are no unit."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[()（ ）]+|[()（ ）]+$", ""), r"(?U)\s+", "")
    return F.when(text.rlike(rf"(?U)^[{UNIT_CHARACTERS}()（）\s]*$"), N.let(bare, lambda b: F.when(b.rlike(f"^{UNIT}$"), b)))


def bracketed(text: Column) -> Column:
    """Brackets without blanks at their edges, and without any inside where they hold a unit."""
    parts = F.regexp_extract_all(text, F.lit(r"\([^()]*\)|\(|[^(]+"), F.lit(0))
    closed = lambda inner: F.concat(F.lit("("), F.coalesce(unit_of(inner), F.trim(inner)), F.lit(")"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\([^()]*\)$"), N.let(F.substr(p, F.lit(2), F.length(p) - 2), closed)).otherwise(p)), "")


def where_found(text: Column, part: str, steps: Callable[[Column], Column]) -> Column:
    """The text after steps, all of which need this part in it: most texts lack most parts, and looking for one costs less than its steps."""
    return N.let(text, lambda x: F.when(x.rlike(rf"(?i){part}"), steps(x)).otherwise(x))


def without_gaps(text: Column, name: str) -> Column:
    """The text with this endpoint of SPACED in one spelling, and a blank before it where it touches a word."""
    after = r"(?=[fpnumµμ]?M(?![A-Za-z0-9])|[^A-Za-z0-9]|$)"
    # a p alone before the rest belongs to it only where no letter stands before it
    own = spaced(name) if name[0] != "p" else r"(?:p" + spaced(name[1:]) + r"|(?<![A-Za-z0-9])p[\s_]+" + spaced(name[1:]) + ")"
    text = F.regexp_replace(text, rf"(?i)(?<=[\p{{L}}\p{{N}}])(?<!p)(?<!p[\s_])(?<!p[\s_]{{2}}){own}{after}" if name == "IC50" else rf"(?i)(?<=[\p{{L}}\p{{N}}]){own}{after}", f" {name}")
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])(?<!p[\s_])(?<!p[\s_]{{2}}){own}{after}" if name == "IC50" else rf"(?i)(?<![\p{{L}}\p{{N}}]){own}{after}", name)


def metric_text(header: Column) -> Column:
    """The header with its endpoints, units and brackets in one spelling; a line that is a unit is put in brackets."""

    def joined(text: Column) -> Column:
        for name in SPACED:
            text = where_found(text, spaced(name), lambda x, name=name: without_gaps(x, name))
        return F.regexp_replace(text, rf"(pIC50|(?<!p)IC50|EC50|DC50|GI50|CC50)(?=[fpnumµμ]?M{END})", "$1 ")

    def spelled(text: Column) -> Column:
        for name in SPELLED:
            text = where_found(text, spaced(name), lambda x, name=name: F.regexp_replace(x, rf"(?i)(?<![A-Za-z0-9]){spaced(name)}{END}", name))
        return text

    text = where_found(F.translate(F.coalesce(header, F.lit("")), GLYPHS, PLAIN), spaced("50"), joined)
    text = where_found(text, "|".join(map(spaced, SPELLED)), spelled)
    lines = F.split(where_found(text, r"\(", bracketed), r"\r?\n")
    return F.array_join(F.transform(lines, lambda x: F.coalesce(F.concat(F.lit("("), unit_of(x), F.lit(")")), x)), "\n")


def metrics(header: Column) -> Column:
    """The metrics that a header names, with the bracket behind each."""
    return F.transform(F.regexp_extract_all(metric_text(header), F.lit(METRIC), F.lit(0)), lambda x: F.trim(x))


def metric_signs(text: Column) -> Column:
    """(metric, whole): whether a text names a metric, and whether it is one; only texts that may are put in one spelling."""
    signs = lambda metric, whole: F.struct(metric.alias("metric"), whole.alias("whole"))
    may = F.lower(F.translate(F.coalesce(text, F.lit("")), GLYPHS + " \t\n\x0b\f\r_", PLAIN)).rlike(POSSIBLE)
    return F.when(may, N.let(metric_text(text), lambda x: signs(x.rlike(METRIC), x.rlike(rf"{METRIC[:4]}^{METRIC[4:]}$")))).otherwise(signs(F.lit(False), F.lit(False)))


def count_role(header: Column) -> Column:
    """What a column of counts counts, if the whole header says so; else null."""
    said = F.lower(F.trim(F.regexp_replace(F.coalesce(header, F.lit("")), r"(?U)\s+", " ")))
    role = F.create_map(*[F.lit(x) for pair in COUNTS.items() for x in pair])
    return F.when((F.length(header) <= 4096) & header.rlike(COUNTED), F.element_at(role, said))


def unknown_field(index: Column) -> Column:
    return F.concat(F.lit("Unknown activity field "), index.cast("string"), F.lit(" (unit unknown)"))


def field_name(header: Column, index: Column) -> Column:
    """The field of a column: its one metric with the unit last, or an unknown field that keeps what is printed.

    Of several metrics none is chosen, and no unit is made up: both are said in the name. Over LONGEST characters nothing is kept.
    """
    clean = F.regexp_replace(F.regexp_replace(metric_text(header), r"(?U)\s+", " "), r"^[ |:：;,.]+|[ |:：;,.]+$", "")
    return N.let(F.regexp_replace(clean, r"\s*\(\s*", " ("), lambda c: N.let(F.regexp_extract_all(c, F.lit(METRIC), F.lit(0)), lambda found: named_field(c, found, index)))


def named_field(clean: Column, found: Column, index: Column) -> Column:
    """``field_name`` of a cleaned header in which these metrics were found."""
    metric = F.trim(F.get(found, F.lit(0)))
    end = F.position(metric, clean) + F.length(metric) - 1
    brackets = F.regexp_extract_all(clean, F.lit(r"\(([^()]*)\)"), F.lit(1))
    units = F.filter(F.transform(brackets, unit_of), lambda u: u.isNotNull())
    # the last bracket with the unit leaves its place for the end
    rest = F.trim(F.regexp_replace(clean, rf"\(\s*{UNIT}\s*\)(?!.*\(\s*{UNIT}\s*\))", ""))
    tail = unit_of(F.substring(clean, end + 1, F.length(clean)))
    bracket = lambda unit: F.concat(F.lit(" ("), unit, F.lit(")"))
    named = (
        F.when((F.size(units) > 0) & (F.size(F.array_distinct(units)) == 1), F.concat(rest, bracket(F.get(units, F.size(units) - 1))))
        .when((F.size(units) == 0) & tail.isNotNull(), F.concat(F.rtrim(F.substring(clean, F.lit(1), end)), bracket(tail)))
        .when((F.size(units) == 0) & ~F.trim(F.substring_index(metric, "(", 1)).rlike(UNITLESS), F.concat(clean, F.lit(" (unit unknown)")))
        .otherwise(clean)
    )
    ending = r"^(.*?)\s*\(([^()]*)\)$"
    ended = (F.size(found) == 0) & clean.rlike(ending)
    label, said = F.when(ended, F.regexp_extract(clean, ending, 1)).otherwise(clean), F.when(ended, F.regexp_extract(clean, ending, 2)).otherwise("unit unknown")
    unknown = F.concat(F.lit("Unknown activity field "), index.cast("string"), F.lit(": "), label, bracket(said))
    chosen = F.when((clean == "") | (F.length(clean) > LONGEST), unknown_field(index)).when(F.size(found) == 1, named).otherwise(unknown)
    return F.regexp_replace(chosen, r"\s+", " ")


def suffixed(name: Column, suffix: Column) -> Column:
    """The name with a suffix before its unit."""
    unit = F.regexp_extract(name, r"\s*(\([^()]+\))$", 1)
    return F.when(unit == "", F.concat(name, F.lit(" "), suffix)).otherwise(F.concat(F.regexp_replace(name, r"\s*\([^()]+\)$", ""), F.lit(" "), suffix, F.lit(" "), unit))


def distinct_fields(names: Column) -> Column:
    """Names of columns in order, told apart by their place where they repeat; no field takes another's name."""

    def own(k: Column, i: Column) -> Column:
        place = (i + 1).cast("string")
        made = suffixed(k, F.concat(F.lit("[column "), place, F.lit("]")))
        twice = suffixed(k, F.concat(F.lit("[column "), place, F.lit("; 2]")))
        repeats = (F.size(F.filter(names, lambda x: x == k)) > 1) | (k == "compound_id")
        return F.when(~repeats, k).when(F.array_contains(names, made), twice).otherwise(made)

    return F.transform(names, own)
