"""Printed identifiers: keys, natural order, aliases and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width characters and their usual forms, a printed identifier, and the label words before one.
WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ－"
NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-"
PRINTED = r"(?:[A-Za-z]{1,12}-?)?[0-9]{1,8}(?:-[0-9]{1,8})*(?:-?[A-Za-z]{1,4})?"
PREFIX = r"(?:Compound|Cmpd|Cpd|Example|实施例|化合物)\s*[-:.：]?\s*"


def narrow(text: Column) -> Column:
    """Full-width letters, digits and hyphens in their usual width, trimmed; nothing if over 128 characters."""
    return F.when(F.length(text) <= 128, F.trim(F.translate(text, WIDE, NARROW))).otherwise("")


def identifier_key(text: Column) -> Column:
    """The identifier behind an optional label word, in capitals; empty if the text is anything else."""
    return F.upper(F.regexp_extract(narrow(F.coalesce(text, F.lit(""))), rf"(?i)^(?:{PREFIX})?({PRINTED})$", 1))


def same_identifier(left: Column, right: Column) -> Column:
    """Equal but for case, or with the same key."""
    key = identifier_key(left)
    return (F.lower(left) == F.lower(right)) | ((key != "") & (key == identifier_key(right)))


def fragments_conflict(text: Column, expected: Column) -> Column:
    """Whether the identifiers in a text speak against the expected one."""
    own = narrow(text)
    whole = F.upper(F.regexp_extract(F.regexp_replace(own, r"\.$", ""), rf"(?i)^(?:{PREFIX})?({PRINTED})$", 1))
    parts = F.array_distinct(F.transform(F.regexp_extract_all(own, F.lit(rf"(?<![\w./-])({PRINTED})(?![\w./-])"), F.lit(1)), lambda x: F.upper(x)))
    return F.when(own == "", F.trim(text) != "").when(whole != "", whole != expected).otherwise((F.size(parts) > 0) & (parts != F.array(expected)))


def natural_key(text: Column) -> Column:
    """Sort key: runs of digits by number (any length), other runs by small letters."""
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        number = run.rlike("^[0-9]")
        return F.struct(F.when(number, 0).otherwise(1).alias("text"), F.when(number, F.length(digits)).otherwise(0).alias("size"), F.when(number, digits).otherwise(F.lower(run)).alias("run"))

    return F.transform(runs, part)


def label(display: Column, identifier: Column, source_label: Column) -> Column:
    """What to show: an explicit rename, the printed label if it has the same key, or the name without its wrapper."""
    printed = F.trim(source_label)
    own = identifier_key(identifier)
    agrees = (own != "") & (identifier_key(F.regexp_replace(printed, r"[.:。]+$", "")) == own) & (F.length(printed) <= 200)
    key = F.regexp_extract(narrow(F.coalesce(display, F.lit(""))), rf"(?i)^(?:{PREFIX})?({PRINTED})$", 1)
    return F.when(display != identifier, display).when(agrees, printed).when(key != "", F.upper(key)).otherwise(display)
