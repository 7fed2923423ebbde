"""Exact measurement values as structs: scalars, censored bounds, ranges, grades, missing.

A bound is (sign, scale, key): sign -2 to 2 (two for the infinities), scale the sign times the
decimal exponent of the first digit, key the significant digits (complemented for negative
numbers). Structs compare field by field, so <, =, min, max and sorting on bounds are exact for
any number of digits, and a change of unit only adds to the exponent. No decimal type of fixed
precision is involved, and no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Context, Decimal

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import cut, spread

#: How a source writes numbers, intervals, ranges and bounds.
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
LEFT = rf"([\[(])\s*({NUMBER})\s*,\s*({NUMBER})\s*([\])])"
RANGE = rf"({NUMBER})\s*(?:-|–|—|\.\.)\s*({NUMBER})"
CENSORED = rf"(<=|>=|<|>|≤|≥)\s*({NUMBER})"
#: What a source writes for a missing value (trimmed, small letters).
MISSING = ("", "na", "n/a", "nd", "nt", "none", "null", "-", "—", "not determined", "not tested", "not available")
#: The extractor's own, stricter set (capitals, without spaces and . _ / -).
MISSING_TOKENS = ("NA", "ND", "NT", "NOTAVAILABLE", "NOTDETERMINED", "NOTTESTED", "UNTESTED")
#: Powers of ten of the molar units, and how percent is written.
MOLAR = {"fM": -15, "pM": -12, "nM": -9, "uM": -6, "mM": -3, "M": 0}
PERCENT = ("%", "％", "percent", "percentage")
#: Conditions and units that say nothing.
UNKNOWN = ("", "unknown", "not recorded", "not specified")
#: Decimal exponents beyond this are refused.
LIMIT = 308
#: White space of all scripts.
SPACE = " \t\r\n\x0b\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def digits_of(parts: Column) -> Column:
    """The parts of a plain number (``parts_of``) with its digits."""
    digits = F.concat(parts[1], parts[2])
    return F.struct(parts[0].alias("sign"), parts[1].alias("whole"), parts[3].alias("power"), digits.alias("digits"), F.ltrim(digits, F.lit("0")).alias("stripped"))


def significant(x: Column) -> Column:
    digits = F.rtrim(x["stripped"], F.lit("0"))
    power = x["power"].try_cast("int")
    adjusted = F.coalesce(power, F.lit(0)) + F.length(x["whole"]) - 1 - (F.length(x["digits"]) - F.length(x["stripped"]))
    return F.struct(digits.alias("key"), adjusted.alias("adjusted"), F.when(digits == "", 0).when(x["sign"] == "-", -1).otherwise(1).alias("sign"), (power.isNotNull() | (x["power"] == "")).alias("fits"))


def within_limit(x: Column) -> Column:
    key = F.when(x["sign"] < 0, F.concat(F.translate(x["key"], "0123456789", "9876543210"), F.lit("~"))).otherwise(x["key"])
    made = F.struct(x["sign"].alias("sign"), (x["sign"] * x["adjusted"]).alias("scale"), key.alias("key"))
    return F.when(x["fits"] & ((x["sign"] == 0) | x["adjusted"].between(-LIMIT, LIMIT)), made)


def parts_of(text: Column) -> Column:
    """Sign, digits before and behind the point, and power of a plain numeric string."""
    return F.split(F.regexp_replace(text, r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$", "$1|$2|$3|$4"), r"\|", -1)


def bound(text: Column) -> Column:
    """The exact number of a plain numeric string; null if it is none or out of range."""
    return let(text, lambda t: F.when(t.rlike(f"^{NUMBER}$"), let(let(let(parts_of(t), digits_of), significant), within_limit)))


def infinite(sign: int) -> Column:
    return F.struct(F.lit(2 * sign).alias("sign"), F.lit(0).alias("scale"), F.lit("").alias("key"))


def exponent(value: Column) -> Column:
    """The decimal exponent of a bound's first digit."""
    return value["sign"] * value["scale"]


def finite(value: Column) -> Column:
    return F.abs(value["sign"]) < 2


def shifted(value: Column, power: Column) -> Column:
    """A bound times ten to a power."""
    return F.when(F.abs(value["sign"]) != 1, value).otherwise(F.struct(value["sign"].alias("sign"), (value["scale"] + value["sign"] * power).cast("int").alias("scale"), value["key"].alias("key")))


def approximate(value: Column) -> Column:
    """A bound as double, for display and averages only."""

    def of(v: Column) -> Column:
        return F.when(v["sign"] == 2, float("inf")).when(v["sign"] == -2, float("-inf")).when(v["sign"] == 0, 0.0).otherwise(written(v).try_cast("double"))

    return let(value, of)


def written(v: Column) -> Column:
    """A finite bound as text, with all its digits."""
    digits = F.when(v["sign"] < 0, F.translate(F.rtrim(v["key"], F.lit("~")), "9876543210", "0123456789")).otherwise(v["key"])
    text = F.concat(F.when(v["sign"] < 0, "-").otherwise(""), F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 400), F.lit("e"), exponent(v).cast("string"))
    return F.when(v["sign"] == 0, "0").when(finite(v), text)


def of_scalars(left: Column, right: Column, body: Callable[[Decimal, Decimal], float | None]) -> Column:
    """A double made of two exact scalars; null unless both are, or if the result is not finite or a false zero."""

    @F.pandas_udf("double")
    def made(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else body(Decimal(x), Decimal(y)) for x, y in zip(a, b)], dtype="float64")

    scalar = lambda v: F.when(v["kind"] == "scalar", written(v["low"]))
    return made(scalar(left), scalar(right))


def double_of(exact: Decimal) -> float | None:
    value = float(exact)
    return None if value in (float("inf"), float("-inf")) or (value == 0 and exact != 0) else value


def difference(reference: Column, candidate: Column) -> Column:
    """Candidate minus reference, exact to all digits before it becomes a double; never of bounds or grades."""
    exact = Context(prec=1300)
    return of_scalars(reference, candidate, lambda a, b: double_of(exact.subtract(b, a)))


def fold(reference: Column, candidate: Column, direction: str) -> Column:
    """How many times better the candidate is, from a quotient of fifty digits; null unless both are positive scalars."""

    def ratio(a: Decimal, b: Decimal) -> float | None:
        over, under = (a, b) if direction == "lower" else (b, a)
        return double_of(Context(prec=50).divide(over, under)) if a > 0 and b > 0 else None

    return of_scalars(reference, candidate, ratio)


def _value(kind: str, low: Column | None = None, high: Column | None = None, lower: Column | bool = True, upper: Column | bool = True, grade: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("struct<sign:int,scale:int,key:string>")
    low, high = (none if x is None else x.cast("struct<sign:int,scale:int,key:string>") for x in (low, high))
    return F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), as_column(lower).alias("lower_closed"), as_column(upper).alias("upper_closed"), (F.lit(None).cast("string") if grade is None else grade).alias("grade"))


def parse(raw: Column, grades: list[str] | None = None) -> Column:
    """A source string as (kind, low, high, lower_closed, upper_closed, grade).

    Kinds: missing, ordinal (one of the given grades), scalar, interval, unsupported. Nothing is
    guessed: bad intervals, numbers out of range and unknown grades are unsupported. Each string is
    read in the one form that it has.
    """
    first = lambda t, pattern, k: F.regexp_extract(t, f"^{pattern}$", k)
    refused = _value("unsupported")

    def scalar(v: Column) -> Column:
        return F.when(v.isNotNull(), _value("scalar", v, v)).otherwise(refused)

    def censored(x: Column) -> Column:
        under = x["op"].isin("<", "<=", "≤")
        made = _value("interval", F.when(under, infinite(-1)).otherwise(x["end"]), F.when(under, x["end"]).otherwise(infinite(1)), ~under & (x["op"] != ">"), under & (x["op"] != "<"))
        return F.when(x["end"].isNotNull(), made).otherwise(refused)

    def interval(x: Column) -> Column:
        proper = (x["low"] < x["high"]) | ((x["low"] == x["high"]) & x["lower"] & x["upper"])
        return F.when(x["low"].isNotNull() & x["high"].isNotNull() & proper, _value("interval", x["low"], x["high"], x["lower"], x["upper"])).otherwise(refused)

    def ends(t: Column, pattern: str, low: int, high: int, lower: Column, upper: Column) -> Column:
        return let(F.struct(bound(first(t, pattern, low)).alias("low"), bound(first(t, pattern, high)).alias("high"), lower.alias("lower"), upper.alias("upper")), interval)

    def value(t: Column) -> Column:
        result = F.when(F.lower(t).isin(*MISSING), _value("missing"))
        if grades:
            result = result.when(t.isin(*grades), _value("ordinal", grade=t))
        result = result.when(F.length(t) > 256, refused)
        result = result.when(t.rlike(f"^{NUMBER}$"), let(bound(t), scalar))
        result = result.when(t.rlike(f"^{CENSORED}$"), let(F.struct(first(t, CENSORED, 1).alias("op"), bound(first(t, CENSORED, 2)).alias("end")), censored))
        result = result.when(t.rlike(f"^{LEFT}$"), ends(t, LEFT, 2, 3, first(t, LEFT, 1) == "[", first(t, LEFT, 4) == "]"))
        return result.when(t.rlike(f"^{RANGE}$"), ends(t, RANGE, 1, 2, F.lit(True), F.lit(True))).otherwise(refused)

    return let(trimmed(F.coalesce(raw, F.lit(""))), value)


#: What the module's readers make of the column __raw, by reader and driver: an expression of hundreds of parts is put together once.
readings: dict[tuple[object, int], Column] = {}


def reading(read: Callable[[Column], Column]) -> Column:
    if read.__closure__ is not None or read.__name__ == "<lambda>":
        return read(F.col("__raw"))
    key = (read, id(SparkContext._gateway))
    if key not in readings:
        readings[key] = read(F.col("__raw"))
    return readings[key]


def read_strings(strings: DataFrame, name: str) -> DataFrame:
    """strings (__raw) with what ``parse`` says of them. Plain numbers, the usual case, take its steps one after the other, so that Spark compiles each; only the rest is left to the whole reader."""
    text = F.col("__text")
    rows = strings.select("__raw", trimmed(F.coalesce("__raw", F.lit(""))).alias("__text"))
    rows = rows.select("__raw", F.when((F.length(text) <= 256) & text.rlike(f"^{NUMBER}$"), parts_of(text)).alias("__step"))
    rows = rows.select("__raw", F.col("__step").isNotNull().alias("__plain"), F.when(F.col("__step").isNotNull(), digits_of(F.col("__step"))).alias("__step"))
    for step in (significant, within_limit):
        rows = rows.select("__raw", "__plain", F.when(F.col("__step").isNotNull(), step(F.col("__step"))).alias("__step"))
    scalar = F.when(F.col("__step").isNotNull(), _value("scalar", F.col("__step"), F.col("__step"))).otherwise(_value("unsupported"))
    return rows.select("__raw", F.when(F.col("__plain"), scalar).otherwise(reading(parse)).alias(name))


def parsed(rows: DataFrame, raw: str, name: str = "v", read: Callable[[Column], Column] | None = None, of: DataFrame | None = None) -> DataFrame:
    """rows with a column of what each source string says: every distinct string is read once.

    What they say is written, so that no filter on it is moved down to the rows and Spark knows its size: it comes back by an
    equality that Spark broadcasts while the strings are few, and splits where one is hot. of: other rows that hold the same
    strings and more, where these are cheaper to look through.
    """
    strings = spread((of if of is not None else rows).select(F.col(raw).alias("__raw")).distinct(), "__raw")
    known = cut(strings.select("__raw", reading(read).alias(name)) if read else read_strings(strings, name), "strings")
    return rows.join(known, F.col(raw).eqNullSafe(F.col("__raw")), "left").drop("__raw")


def strictly_below(left: Column, right: Column) -> Column:
    """Whether every possible left value lies below every possible right one."""
    touching = (left["high"] == right["low"]) & finite(left["high"]) & ~(left["upper_closed"] & right["lower_closed"])
    return (left["high"] < right["low"]) | touching


def compare(reference: Column, candidate: Column, direction: str, grades: list[str] | None = None) -> Column:
    """better, worse, equal, or indeterminate: an order is only told when all possible values agree."""
    place = lambda v: F.array_position(F.array(*[F.lit(g) for g in grades or [""]]), v["grade"])
    lower_wins = direction == "lower"
    ordinal = (reference["kind"] == "ordinal") | (candidate["kind"] == "ordinal")
    measured = reference["kind"].isin("scalar", "interval") & candidate["kind"].isin("scalar", "interval")
    graded = F.when((reference["kind"] != candidate["kind"]) | (reference["grade"] == candidate["grade"]), "indeterminate").when(place(candidate) < place(reference), "better").otherwise("worse")
    equal = (reference["kind"] == "scalar") & (candidate["kind"] == "scalar") & (reference["low"] == candidate["low"])
    return (
        F.when(ordinal, graded)
        .when(~measured, "indeterminate")
        .when(equal, "equal")
        .when(strictly_below(candidate, reference), "better" if lower_wins else "worse")
        .when(strictly_below(reference, candidate), "worse" if lower_wins else "better")
        .otherwise("indeterminate")
    )


def is_missing(raw: Column) -> Column:
    return F.lower(trimmed(F.coalesce(raw, F.lit("")))).isin(*MISSING)


def is_missing_token(raw: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\s._/-]+", "")).isin(*MISSING_TOKENS)


def unit_of(unit: Column) -> Column:
    """(family, power): molar with its power of ten, percent, or null for any other unit."""
    symbol = F.translate(trimmed(F.coalesce(unit, F.lit(""))), "µμ", "uu")
    power = F.create_map(*[F.lit(x) for p in MOLAR.items() for x in p])[symbol]
    return F.when(power.isNotNull(), F.struct(F.lit("molar").alias("family"), power.alias("power"))).when(F.lower(symbol).isin(*PERCENT), F.struct(F.lit("percent").alias("family"), F.lit(0).alias("power")))


def inline(raw: Column, declared: Column) -> Column:
    """A cell with an explicit unit suffix, read in the declared unit; families never mix."""
    pattern = r"(?s)^(.+?)\s*(fM|pM|nM|[uµμ]M|mM|M|%|％)$"
    parts = lambda t: F.struct(t.alias("t"), F.regexp_extract(t, pattern, 1).alias("body"), F.regexp_extract(t, pattern, 2).alias("suffix"))

    def of(x: Column) -> Column:
        read = F.struct(x["suffix"].alias("suffix"), unit_of(x["suffix"]).alias("own"), unit_of(declared).alias("basis"), parse(F.when(x["suffix"] == "", x["t"]).otherwise(x["body"])).alias("v"))
        return let(read, moved)

    def moved(x: Column) -> Column:
        v, power = x["v"], x["own"]["power"] - x["basis"]["power"]
        turned = _value("scalar", shifted(v["low"], power), shifted(v["high"], power), v["lower_closed"], v["upper_closed"], v["grade"])
        return F.when(x["suffix"] == "", v).when(x["own"]["family"] == x["basis"]["family"], turned.withField("kind", v["kind"])).otherwise(_value("unsupported"))

    return let(trimmed(raw), lambda t: let(parts(t), of))


def declared(raw: Column, unit: Column) -> Column:
    """A cell that may end with its declared unit, written out literally; a number that can be read as it stands is.

    The unit must have a letter and say something; one that begins with a digit needs white space before it.
    """

    def of(x: Column) -> Column:
        ends = (x["unit"] != "") & ~F.lower(x["unit"]).isin(*UNKNOWN) & x["unit"].rlike(r"\p{L}") & x["text"].endswith(x["unit"])
        body = F.substr(x["text"], F.lit(1), F.length(x["text"]) - F.length(x["unit"]))
        fits = ends & (body != "") & (~x["unit"].rlike("^[0-9]") | body.rlike(r"\s$"))
        behind = let(parse(F.when(fits, body)), lambda v: F.when(fits & v["kind"].isin("scalar", "interval"), v).otherwise(_value("unsupported")))
        return let(parse(x["text"]), lambda v: F.when(v["kind"] == "unsupported", behind).otherwise(v))

    return let(F.struct(trimmed(F.coalesce(raw, F.lit(""))).alias("text"), trimmed(F.coalesce(unit, F.lit(""))).alias("unit")), of)


def rank_value(raw: Column) -> Column:
    """(kind, value) of an exact scalar, one to eight plus signs, or a capital letter; else null."""
    of = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("value"))

    def rank(text: Column) -> Column:
        number = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"), text.try_cast("double"))
        return F.when(text.rlike(r"^\+{1,8}$"), of("plus", F.length(text))).when(text.rlike("^[A-Z]$"), of("letter", F.ascii(text) - 65)).when(number.isNotNull() & (F.abs(number) < float("inf")), of("numeric", number))

    return let(trimmed(raw), rank)


def evidence(raw: Column) -> Column:
    """(number, censored): an exact number, or whether the text is a bound or a range."""
    text = F.translate(trimmed(raw), "−", "-")
    ranged = text.rlike(rf"(?i)^{NUMBER}\s*(?:-|–|—|~|～|to)\s*{NUMBER}$")
    censored = text.rlike("^[<>≤≥≲≳≈~≠]") | ranged
    number = F.when(~censored & text.rlike(f"^{NUMBER}$"), text.try_cast("double"))
    return F.struct(F.when(F.abs(number) < float("inf"), number).alias("number"), F.coalesce(censored, F.lit(False)).alias("censored"))
