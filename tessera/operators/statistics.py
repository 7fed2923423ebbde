"""Summaries, strength scales, percentiles and histograms of repeated measurements."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.sources.scratch import cut, spread

#: The bins of a strength scale.
STRENGTHS = ("strong", "medium", "weak", "unclassified")


def evidence_summary(rows: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """By context: rows, numeric rows, minimum, maximum, censored rows."""
    read = N.parsed(rows.groupBy(*keys, raw).agg(F.count("*").alias("n")), raw, "__e", N.evidence, rows)
    number = F.col("__e.number")
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return read.groupBy(*keys).agg(F.sum("n").alias("n_rows"), of(number.isNotNull()).alias("n_numeric"), F.min(number).alias("min_value"), F.max(number).alias("max_value"), of(F.col("__e.censored")).alias("n_censored"))


def context_catalogue(rows: DataFrame, keys: list[str], subject: str, raw: str, samples: int = 32) -> DataFrame:
    """By context: subjects, observations, distinct values, and the first values in order.

    Values are counted once each before they are gathered, and of each context only the first
    ``samples`` are, so a context with very many values does not meet in one task.
    """
    pairs = rows.groupBy(*keys, raw).agg(F.count("*").alias("n"))
    totals = pairs.groupBy(*keys).agg(F.sum("n").alias("n_observations"), F.count(raw).alias("n_values"))
    subjects = rows.groupBy(*keys).agg(F.count_distinct(subject).alias("n_subjects"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(raw))
    first = pairs.where(F.col(raw).isNotNull()).withColumn("__n", place).where(F.col("__n") <= samples)
    shown = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(raw)), "|").alias("samples"))
    return totals.join(subjects, keys).join(shown, keys, "left")


def tied_terciles(rows: DataFrame, keys: list[str], value: str, best: str = "low") -> DataFrame:
    """(keys, n, first_cut, second_cut): cuts that split the values nearest to thirds without dividing ties.

    Distinct values from the best; the first cut minimises |3c - n| with two values after it, the second
    |3c - 2n| after the first with one after it; the earliest wins ties. Under three values, both cuts
    are the best value. Works on counts by value: as many rows as a context has distinct values.
    """
    order = F.asc(value) if best == "low" else F.desc(value)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    run, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    cum = counts.select(*keys, value, F.sum("c").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.row_number().over(run).alias("i"), F.count("*").over(whole).alias("k"), F.sum("c").over(whole).alias("n"))
    first = F.min(F.when((F.col("k") >= 3) & (F.col("i") <= F.col("k") - 2), F.struct(F.abs(3 * F.col("cum") - F.col("n")).alias("d"), "i", F.col(value).alias("v")))).over(whole)
    marked = cum.withColumn("f", first)
    second = F.min(F.when((F.col("i") > F.col("f.i")) & (F.col("i") <= F.col("k") - 1), F.struct(F.abs(3 * F.col("cum") - 2 * F.col("n")).alias("d"), "i", F.col(value).alias("v"))))
    lead = F.min_by(value, "i")
    return marked.groupBy(*keys).agg(F.first("n").alias("n"), F.coalesce(F.first("f")["v"], lead).alias("first_cut"), F.coalesce(second["v"], lead).alias("second_cut"))


def rank_profile(rows: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """By context: the one kind of its ranked values or mixed_types, ranked and excluded rows, distinct values, limits."""
    read = N.parsed(rows.groupBy(*keys, raw).agg(F.count("*").alias("n")), raw, "__r", N.rank_value, rows)
    kinds = F.count_distinct("__r.kind")
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return read.groupBy(*keys).agg(F.when(kinds > 1, "mixed_types").otherwise(F.coalesce(F.min("__r.kind"), F.lit("none"))).alias("kind"), of(F.col("__r").isNotNull()).alias("n_ranked"), of(F.col("__r").isNull()).alias("n_excluded"), F.count_distinct("__r.value").alias("n_distinct"), F.min("__r.value").alias("low"), F.max("__r.value").alias("high"))


def folded(rows: DataFrame, keys: list[str], subject: str, raw: str) -> DataFrame:
    """(keys, subject, low, high, lower_closed, upper_closed): the hull of each measured subject's repeats.

    A subject with an unsupported or ordinal reading, or with both missing and measured ones, could be
    anything. An end is closed if any reading that owns it is. Subjects with missing readings alone leave.
    """
    read = N.parsed(spread(rows.select(*keys, subject, raw), *keys, subject).distinct(), raw, of=rows)
    kind = F.col("v.kind")
    measured = kind.isin("scalar", "interval")
    low = F.min(F.when(measured, F.struct("v.low", (~F.col("v.lower_closed")).alias("open"))))
    high = F.max(F.when(measured, F.struct("v.high", F.col("v.upper_closed").alias("closed"))))
    merged = read.groupBy(*keys, subject).agg(low.alias("l"), high.alias("h"), F.count_if(kind == "missing").alias("n_missing"), F.count_if(measured).alias("n_measured"), F.count("*").alias("n"))
    merged = merged.where("n > n_missing")
    unsure = (F.col("n_measured") < F.col("n")) | (F.col("h.high.sign") <= 0)
    end = "struct<sign:int,scale:int,key:string>"
    return merged.select(*keys, subject, F.when(unsure, N.infinite(-1).cast(end)).otherwise(F.col("l.low").cast(end)).alias("low"), F.when(unsure, N.infinite(1).cast(end)).otherwise(F.col("h.high").cast(end)).alias("high"), F.when(unsure, False).otherwise(~F.col("l.open")).alias("lower_closed"), F.when(unsure, False).otherwise(F.col("h.closed")).alias("upper_closed"), unsure.alias("uncertain"))


def tenth_decade(rows: DataFrame, keys: list[str], subject: str, raw: str) -> DataFrame:
    """(keys, n_subjects, status, decade): the decade of the tenth smallest subject, if all possible values agree.

    Under ten subjects: insufficient. The tenth of the lower ends and the tenth of the upper ones must
    be positive, finite and in one decade (an open upper end on a power of ten belongs to the one
    below); else ambiguous. Strong values lie below 10^(decade+1), medium ones below 10^(decade+2).
    """
    subjects = cut(folded(rows, keys, subject, raw).select(*keys, "low", "high", "lower_closed", "upper_closed"), "hulls")
    by_low = Window.partitionBy(*keys).orderBy("low", F.col("lower_closed").cast("int").desc())
    by_high = Window.partitionBy(*keys).orderBy("high", F.col("upper_closed").cast("int"))
    # of a context only ten rows a task go on to the sort
    first = lambda order, names: subjects.withColumn("i", F.row_number().over(order)).where("i <= 10").where("i = 10").select(*keys, *names)
    lows = first(by_low, [F.col("low").alias("lo")])
    highs = first(by_high, [F.struct("high", "upper_closed").alias("hi")])
    alike = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    counts = subjects.groupBy(*keys).agg(F.count("*").alias("n_subjects"))
    tenth = counts.alias("a").join(lows.alias("l"), alike("a", "l"), "left").join(highs.alias("h"), alike("a", "h"), "left").select("a.*", "l.lo", "h.hi")
    edge = ~F.col("hi.upper_closed") & (F.col("hi.high.key") == "1")
    up = N.exponent(F.col("hi.high")) - F.when(edge, 1).otherwise(0)
    sure = (F.col("lo.sign") == 1) & (F.col("hi.high.sign") == 1) & (N.exponent(F.col("lo")) == up)
    status = F.when(F.col("n_subjects") < 10, "insufficient").when(sure, "ready").otherwise("ambiguous")
    return tenth.select(*keys, "n_subjects", status.alias("status"), F.when(status == "ready", up).alias("decade"))


def band(value: Column, decade: Column) -> Column:
    """strong, medium, weak or unclassified: a parsed value against the scale's two powers of ten."""
    limit = lambda k: F.struct(F.lit(1).alias("sign"), (decade + k).cast("int").alias("scale"), F.lit("1").alias("key"))
    under = lambda k: (value["high"] < limit(k)) | ((value["high"] == limit(k)) & ~value["upper_closed"])
    measured = value["kind"].isin("scalar", "interval") & decade.isNotNull()
    return F.when(~measured, "unclassified").when(under(1), "strong").when((value["low"] >= limit(1)) & under(2), "medium").when(value["low"] >= limit(2), "weak").otherwise("unclassified")


def readings(rows: DataFrame, keys: list[str], subject: str, raw: str) -> DataFrame:
    """(keys, subject, raw, n): what a scale and its bands both read, counted and written once."""
    return cut(spread(rows.select(*keys, subject, raw), *keys, subject).groupBy(*keys, subject, raw).agg(F.count("*").alias("n")), "readings")


def banded(counts: DataFrame, scale: DataFrame, keys: list[str], subject: str, raw: str) -> DataFrame:
    """(keys, subject, raw, n, band): ``readings`` in the bands of their context's scale (``tenth_decade``)."""
    return N.parsed(counts, raw).join(scale.select(*keys, "decade"), keys, "left").select(*keys, subject, raw, "n", band(F.col("v"), F.col("decade")).alias("band"))


def proven_strong(value: Column, threshold: Column, inclusive: bool, direction: str) -> Column:
    """Whether every possible value is on the strong side of a threshold."""
    if direction == "lower":
        at = (value["high"] == threshold) & (F.lit(inclusive) | ~value["upper_closed"])
        return (value["high"] < threshold) | at
    at = (value["low"] == threshold) & (F.lit(inclusive) | ~value["lower_closed"])
    return (value["low"] > threshold) | at


def assessment(rows: DataFrame, keys: list[str], subject: str, raw: str) -> DataFrame:
    """(keys, subject, state): missing, conflicting, partial or unsupported readings, or the one kind that agrees."""
    read = N.parsed(spread(rows.select(*keys, subject, raw), *keys, subject).groupBy(*keys, subject, raw).agg(F.count("*").alias("n")), raw, of=rows)
    total = lambda kind: F.sum(F.when(F.col("v.kind") == kind, F.col("n")).otherwise(0))
    same = F.struct("v.low", "v.high", "v.lower_closed", "v.upper_closed", "v.grade")
    counted = read.groupBy(*keys, subject).agg(F.sum("n").alias("n"), total("missing").alias("n_missing"), total("unsupported").alias("n_unsupported"), F.min(F.when(F.col("v.kind") != "missing", same)).alias("a"), F.max(F.when(F.col("v.kind") != "missing", same)).alias("b"), F.min(F.when(F.col("v.kind") != "missing", F.col("v.kind"))).alias("kind"))
    state = F.when(F.col("n") == F.col("n_missing"), "missing").when(F.col("n_unsupported") > 0, "unsupported").when(F.col("n_missing") > 0, "partial").when(F.col("a") != F.col("b"), "conflicting").otherwise(F.col("kind"))
    return counted.select(*keys, subject, "n", state.alias("state"))


def midrank(rows: DataFrame, keys: list[str], value: str, better: str = "low") -> DataFrame:
    """Add percentile: (rows that are worse + (ties - 1) / 2) / (rows - 1); 0.5 for a single row."""
    worse_first = F.desc(value) if better == "low" else F.asc(value)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(worse_first)) - 1
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("percentile", F.when(n == 1, 0.5).otherwise((rank + (ties - 1) / 2) / (n - 1)))


def exact_place(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin, from 0, of an exact value between two others, all as written digits; the highest value belongs to the last bin.

    The quotient is exact whatever the number of digits; apply it to distinct values.
    """

    @F.pandas_udf("int")
    def placed(v: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        number = lru_cache(maxsize=4096)(lambda text: Fraction(Decimal(text)))
        of = lambda x, a, b: 0 if a == b else min(bins - 1, int((number(x) - number(a)) * bins / (number(b) - number(a))))
        return pd.Series([None if pd.isna(x) else of(x, a, b) for x, a, b in zip(v, lo, hi)], dtype="Int32")

    return placed(value, low, high)


def histogram(rows: DataFrame, keys: list[str], subject: str, raw: str, bins: int = 8, scale: DataFrame | None = None) -> DataFrame:
    """(keys, bin, n_observations, n_subjects): equal bins over the context's scalar range, and named bins.

    Observations count where they fall. Subjects count once: where their one value falls, or as missing, as partial (some readings
    are missing) or as conflicting measurements; so the subjects of all bins add up to the context's. Bins of numbers are
    there even if they are empty, and one stands for a range of one value. With a scale (``tenth_decade``) of the keys,
    numbers and intervals count by strength (strong, medium, weak, unclassified) instead, subjects by that of all their readings together.
    """
    counts = readings(rows, keys, subject, raw).withColumnRenamed("n", "__n")
    values = N.parsed(counts.groupBy(*keys, raw).agg(F.sum("__n").alias("__n")), raw, "__v")
    same = F.struct("__v.kind", "__v.low", "__v.high", "__v.lower_closed", "__v.upper_closed", "__v.grade").alias("__same")
    scalar = F.when(F.col("__v.kind") == "scalar", F.col("__v.low"))
    values = cut(values.select(*keys, raw, "__n", "__v", same, scalar.alias("__x")), "values")
    span = values.groupBy(*keys).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    if scale is None:
        written = [N.written(F.col(c)) for c in ("__x", "__lo", "__hi")]
        name = F.when(F.col("__x").isNotNull(), F.concat(F.lit("bin "), exact_place(*written, bins).cast("string"))).otherwise(F.col("__v.kind"))
        placed = values.join(span, keys).withColumn("bin", name)
        seeds = span.where("__lo is not null").select(*keys, F.explode(F.when(F.col("__lo") == F.col("__hi"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("__k")).select(*keys, F.concat(F.lit("bin "), F.col("__k").cast("string")).alias("bin"))
    else:
        decades = scale.select(*keys, "decade")
        measured = F.col("__v.kind").isin("scalar", "interval")
        placed = values.join(decades, keys, "left").withColumn("bin", F.when(measured, band(F.col("__v"), F.col("decade"))).otherwise(F.col("__v.kind")))
        seeds = span.select(*keys, F.explode(F.array(*[F.lit(t) for t in STRENGTHS])).alias("bin"))
    placed = cut(placed.select(*keys, raw, "__n", "bin", "__same"), "placed")
    observed = placed.groupBy(*keys, "bin").agg(F.sum("__n").alias("n_observations"))
    alike = lambda side: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in side]
    read = counts.alias("a").join(placed.alias("b"), alike([*keys, raw])).select("a.*", "b.bin", "b.__same")
    absent = F.col("__same.kind") == "missing"
    own = read.groupBy(*keys, subject).agg(F.count_if(absent).alias("__absent"), F.count("*").alias("__k"), F.min("__same").alias("__one"), F.max("__same").alias("__other"), F.min("bin").alias("bin"))
    if scale is not None:
        whole = folded(rows, keys, subject, raw).join(decades, keys, "left")
        value = F.struct(F.lit("interval").alias("kind"), "low", "high", "lower_closed", "upper_closed")
        whole = whole.select(*keys, subject, band(value, F.col("decade")).alias("__strength"))
        own = own.alias("a").join(whole.alias("b"), alike([*keys, subject]), "left").select("a.*", "b.__strength")
    else:
        own = own.withColumn("__strength", F.lit(None).cast("string"))
    where = F.when(F.col("__absent") == F.col("__k"), "missing").when(F.col("__strength").isNotNull(), F.col("__strength")).when(F.col("__one") == F.col("__other"), F.col("bin")).when(F.col("__absent") > 0, "partial measurements").otherwise("conflicting measurements")
    members = own.select(*keys, where.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n_subjects"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return observed.join(members, [*keys, "bin"], "full").join(seeds, [*keys, "bin"], "full").select(*keys, "bin", zero("n_observations"), zero("n_subjects"))


def lead_evidence(rows: DataFrame, context: list[str], subject: str, value: str, better: str = "low") -> DataFrame:
    """(subject, potency, ranked, coverage): the worst repeat of each context, its mid-rank, and their mean.

    A null value is an invalid repeat: it takes the subject out of that context.
    """
    worst = F.max(value) if better == "low" else F.min(value)
    own = rows.groupBy(*context, subject).agg(worst.alias("v"), F.count_if(F.col(value).isNull()).alias("bad")).where("bad = 0")
    ranked = midrank(own, context, "v", better)
    total = own.select(*context).distinct().agg(F.count("*").alias("n_contexts"))
    mean = ranked.groupBy(subject).agg((100 * F.avg("percentile")).alias("potency"), F.count("*").alias("ranked"))
    return mean.crossJoin(F.broadcast(total)).withColumn("coverage", F.col("ranked") / F.col("n_contexts"))  # total is one row
