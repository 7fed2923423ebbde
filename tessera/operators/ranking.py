"""Orders, Pareto fronts and greedy diverse selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.functions.identifiers import natural_key
from tessera.functions.numbers import let, parsed, rank_value
from tessera.sources.scratch import cut, in_file_order, release


#: Vectors of a group that one task ranks, and pairs that are compared one by one.
BLOCK, FEW = 50_000, 1 << 12


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Place in a total order over the whole table.

    One sort, written to the shared folder: range partitions are sorted in parallel, and places come
    from the files, so they hold however often the table is read. No task holds the table: as many ranges
    as the session has shuffle partitions are not joined again, however few bytes their rows take while they move.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_file_order(cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), "ordered"), name)


def workbook_key(value: Column) -> Column:
    """(missing, kind, number, text): what a cell is sorted by; missing ones are all alike."""
    known = F.trim(F.coalesce(value, F.lit(""))) != ""

    def key(rank: Column) -> Column:
        return F.struct((~known).alias("missing"), F.when(known, F.coalesce(rank["kind"], F.lit("text"))).alias("kind"), rank["value"].alias("number"), F.when(known & rank.isNull(), natural_key(value)).alias("text"))

    return let(rank_value(value), key)


def workbook_order(rows: DataFrame, value: str, ordinal: list[str], descending: bool = False) -> tuple[DataFrame, list[Column]]:
    """The rows with a key __key, and their order: known values first (numbers before text), missing last in both directions, ties in table order.

    Each distinct cell is read once.
    """
    keys = [F.col(f"__key.{k}") for k in ("kind", "number", "text")]
    turned = [k.desc() if descending else k.asc() for k in keys]
    return parsed(rows, value, "__key", workbook_key), [F.col("__key.missing").asc(), *turned, *[F.col(c).asc() for c in ordinal]]


def study_order(rows: DataFrame, label: Column, identity: str, value: Column | None = None, descending: bool = False) -> tuple[DataFrame, list[Column]]:
    """The rows with keys __known, __label, and their order: by the label (both directions turn it), or by a value.

    By a value, only known values turn with the direction: ties keep the labels' natural order, and unknown rows come last in that order.
    """
    keyed = rows.withColumns({"__label": natural_key(label), "__known": value if value is not None else F.lit(None)})
    base = [F.col("__label"), F.col(identity)]
    if value is None:
        return keyed, [c.desc() if descending else c.asc() for c in base]
    known = F.col("__known")
    return keyed, [known.isNull().asc(), known.desc() if descending else known.asc(), *[c.asc() for c in base]]


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page after a full sort; a top-k plan, not a sort of the table."""
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("page and size out of range")
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def dominates(a: str, b: str, lower: list[str], higher: list[str]) -> Column:
    """Whether row a is nowhere worse than row b and somewhere better."""
    col = lambda side, c: F.col(f"{side}.{c}")
    no_worse = [col(a, c) <= col(b, c) for c in lower] + [col(a, c) >= col(b, c) for c in higher]
    better = [col(a, c) < col(b, c) for c in lower] + [col(a, c) > col(b, c) for c in higher]
    return reduce(lambda x, y: x & y, no_worse) & reduce(lambda x, y: x | y, better)


def pareto_front(rows: DataFrame, keys: list[str], lower: str, higher: str) -> DataFrame:
    """The rows of the first front over two exact costs, by one sort: no better row comes before in either.

    In order of the first cost, a row is on the front if its second is better than the best of all
    strictly cheaper rows, and is the best of its equals.
    """
    by = Window.partitionBy(*keys)
    before = by.orderBy(lower).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    vectors = rows.select(*keys, lower, higher).distinct()
    top = vectors.groupBy(*keys, lower).agg(F.max(higher).alias(higher))
    ahead = F.max(higher).over(before.rowsBetween(Window.unboundedPreceding, -1))
    front = top.withColumn("__a", ahead).where(F.col("__a").isNull() | (F.col(higher) > F.col("__a"))).drop("__a")
    return rows.join(front, [*keys, lower, higher], "left_semi")


def pareto_depths(rows: DataFrame, groups: list[str], identity: str, costs: list[tuple[str, str]] | str, most: int | None = None) -> DataFrame:
    """(groups, identity, front): successive fronts over interval costs (low column, high column; less is better).

    costs may also name a column of arrays low, high, low, high, ... of one length within a group. A vector
    dominates another if every cost is equal or proven no worse and one is proven better; overlapping intervals prove
    nothing. Equal vectors share a front, and meet once. Exact ends, open or closed, become costs by ``interval_places``.

    A group's distinct vectors are sorted so that whatever dominates one comes before it, and dealt into blocks of BLOCK. Blocks of all groups are
    ranked one rank of blocks after the other, each within itself (``chained``) from the deepest earlier front that dominates each of its vectors
    (``deepest``). Of earlier vectors of up to two costs whose first lies below all that follow, only the one with the least second cost of each front
    is carried on: it dominates whatever the others of its front do. What is carried comes in parts of BLOCK too, each in a task of its own.
    A group of one block, the usual case, needs one round. With most, a group of more rows is refused.
    """
    vector = F.col(costs) if isinstance(costs, str) else F.array(*[F.col(c).cast("double") for pair in costs for c in pair])
    own = rows.select(*groups, identity, vector.alias("__c"))
    if most is not None:
        own = own.withColumn("__n", F.count("*").over(Window.partitionBy(*groups))).where(F.when(F.col("__n") > most, F.raise_error(F.lit("too many rows to rank"))).otherwise(F.lit(True))).drop("__n")
    own = own.withColumn("__g", F.struct(*groups) if groups else F.struct(F.lit(0).alias("g")))
    placed = numbered(own.select("__g", "__c").distinct(), [F.col("__g"), F.col("__c")], "__place")
    begins = placed.groupBy("__g").agg(F.min("__place").alias("__begin"))
    alike = lambda a, b, *names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    block = F.floor((F.col("a.__place") - F.col("b.__begin")) / BLOCK).cast("long").alias("__b")
    blocks = cut(placed.alias("a").join(begins.alias("b"), alike("a", "b", "__g")).select("a.__g", "a.__c", "a.__place", block), "vectors")
    kinds = ", ".join(f"{c} {t}" for c, t in blocks.dtypes)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        """The fronts of one block, in order, from those that earlier blocks force on it."""
        pdf = pdf.sort_values("__place")
        return pdf.drop(columns=["forced"]).assign(front=chained(*places_of_ends(np.vstack(pdf["__c"].to_numpy())), pdf["forced"].to_numpy()))

    def across(key, before: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
        """For each vector of a block the deepest front of what is carried that dominates it."""
        if not len(before) or not len(after):
            return pd.DataFrame({"__place": [], "forced": []}).astype({"__place": "int64", "forced": "int64"})
        high, low = places_of_ends(np.vstack([*before["__c"], *after["__c"]]))
        found = deepest(high[: len(before)], before["front"].to_numpy(), low[len(before) :])
        return pd.DataFrame({"__place": after["__place"], "forced": found})

    zero = F.lit(0).cast("long").alias("forced")
    done = [cut(blocks.where("__b = 0").select("*", zero).groupBy("__g").applyInPandas(within, f"{kinds}, front long"), "fronts")]
    carried, end = done[0].select("__g", F.col("__b").alias("__o"), "__c", "front"), lambda k: F.get("r.__c", F.lit(k))
    for b in range(1, (blocks.agg(F.max("__b")).first()[0] or 0) + 1):
        fresh = blocks.where(F.col("__b") == b)
        opens = fresh.groupBy("__g").agg(F.min(F.get("__c", F.lit(0))).alias("__opens"))
        # what is passed stands behind the blocks' numbers, by its front
        part = F.when((F.size("r.__c") <= 4) & (end(1) < F.col("f.__opens")), -1 - F.floor(F.col("r.front") / BLOCK)).otherwise(F.col("r.__o")).cast("long").alias("__o")
        met = carried.alias("r").join(opens.alias("f"), alike("r", "f", "__g")).select("r.__g", part, "r.__c", "r.front")
        least = met.where("__o < 0").groupBy("__g", "__o", "front").agg(F.min_by("__c", F.struct(F.get("__c", F.lit(3)), F.get("__c", F.lit(2)) < F.get("__c", F.lit(3)))).alias("__c"))
        kept = cut(met.where("__o >= 0").unionByName(least), "carried")
        wanted = fresh.alias("b").join(kept.select("__g", F.col("__o").alias("__part")).distinct().alias("k"), alike("b", "k", "__g")).select("b.__g", "b.__c", "b.__place", "k.__part")
        forced = kept.groupBy("__g", "__o").cogroup(wanted.groupBy("__g", "__part")).applyInPandas(across, "__place long, forced long").groupBy("__place").agg(F.max("forced").alias("forced"))
        more = fresh.join(forced, "__place").select(*blocks.columns, "forced").groupBy("__g").applyInPandas(within, f"{kinds}, front long")
        done.append(cut(more, "fronts"))
        if b > 1:
            release(earlier)
        earlier, carried = kept, kept.union(done[-1].select("__g", "__b", "__c", "front"))
    ranked = reduce(DataFrame.union, done)
    return own.alias("a").join(ranked.alias("b"), alike("a", "b", "__g", "__c")).select(*[F.col(f"a.{c}") for c in (*groups, identity)], "b.front")


def places_of_ends(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers for the high and the low ends of vectors (low, high, low, high, ...): of two distinct ones, the first dominates if none of its highs exceeds the other's low.

    An end that is no point lies half a place further in, so that touching ends prove an order of points alone. Ends that are no numbers prove nothing.
    """
    low, high = values[:, ::2], values[:, 1::2]
    known = np.unique(values[~np.isnan(values)])
    wide = (low != high).astype(np.int64)
    above, below = 2 * np.searchsorted(known, high) + wide, 2 * np.searchsorted(known, low) - wide
    return np.where(np.isnan(high), 2 * len(known) + 2, above), np.where(np.isnan(low), -2, below)


def deepest(high: np.ndarray, front: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each row of low the greatest front of the rows of high that exceed it nowhere; 0 if there is none.

    Halves by the first place: what is low there meets what is high there by the places behind it, and each half itself.
    """
    if not len(high) or not len(low):
        return np.zeros(len(low), np.int64)
    if len(high) * len(low) <= FEW:
        return np.where((high[:, None] <= low[None]).all(axis=2), front[:, None], 0).max(axis=0)
    if high.shape[1] == 1:
        order = np.argsort(high[:, 0], kind="stable")
        best = np.concatenate([[0], np.maximum.accumulate(front[order])])
        return best[np.searchsorted(high[order, 0], low[:, 0], side="right")]
    a, b = high[:, 0], low[:, 0]
    both = np.concatenate([a, b])
    middle = np.partition(both, len(both) // 2)[len(both) // 2]
    found = np.zeros(len(low), np.int64)
    for one, two, skip in ((a <= middle, b >= middle, 1), (a < middle, b < middle, 0), (a > middle, b > middle, 0)):
        found[two] = np.maximum(found[two], deepest(high[one][:, skip:], front[one], low[two][:, skip:]))
    return found


def chained(high: np.ndarray, low: np.ndarray, forced: np.ndarray) -> np.ndarray:
    """The front of each vector, one deeper than the deepest that dominates it, in an order in which that comes before it; forced are those of others."""
    front = forced.copy()

    def rank(start: int, stop: int) -> None:
        if stop - start <= 32:
            for k in range(start, stop):
                over = (high[start:k] <= low[k]).all(axis=1)
                front[k] = 1 + max(front[k], front[start:k][over].max(initial=0))
            return
        middle = (start + stop) // 2
        rank(start, middle)
        front[middle:stop] = np.maximum(front[middle:stop], deepest(high[start:middle], front[start:middle], low[middle:stop]))
        rank(middle, stop)

    rank(0, len(front))
    return front


def interval_places(rows: DataFrame, values: list[str], better: list[str]) -> DataFrame:
    """rows with ``<value>_low`` and ``<value>_high`` for each parsed value (``numbers.parse``): places of its exact ends among all ends, less is better.

    Places compare as the ends do, to the last digit: an open end that touches a closed one proves an order, two closed ones that touch do not.
    Values without numbers could be anything. better says for each value whether lower or higher is better. Ends are told apart once each.
    """
    ends = None
    for v in values:
        at = lambda side, shift, v=v: F.struct(F.col(f"{v}.{side}").alias("x"), shift.alias("shift"))
        measured = F.col(f"{v}.kind").isin("scalar", "interval")
        low = at("low", F.when(F.col(f"{v}.lower_closed"), 0).otherwise(1))
        high = at("high", F.when(F.col(f"{v}.upper_closed"), 0).otherwise(-1))
        rows = rows.withColumns({f"__{v}_low": F.when(measured, low), f"__{v}_high": F.when(measured, high)})
        for side in ("low", "high"):
            one = rows.select(F.col(f"__{v}_{side}").alias("__end"))
            ends = one if ends is None else ends.union(one)
    known = numbered(ends.where("__end is not null").distinct(), [F.col("__end")], "__at")
    for v, way in zip(values, better):
        for side in ("low", "high"):
            name, own = f"{v}_{side}" if way == "lower" else f"{v}_{'high' if side == 'low' else 'low'}", f"__{v}_{side}"
            place = known.withColumnRenamed("__end", f"{own}_end")
            joined = rows.join(place, F.col(own) == F.col(f"{own}_end"), "left").drop(f"{own}_end")
            infinite = -float("inf") if (side == "low") == (way == "lower") else float("inf")
            rows = joined.withColumn(name, F.coalesce((F.col("__at") * (1 if way == "lower" else -1)).cast("double"), F.lit(infinite))).drop("__at", own)
    return rows



def secondary_evidence(rows: DataFrame, identity: str, front: str, predictions: str, directions: dict[str, str], verified: Column, physical: list[Column]) -> DataFrame:
    """(identity, unverified, neg_endpoints, own_front, neg_coverage, review): what breaks ties within an activity front, less first.

    Rows whose predictions are verified and in 0 to 1 are ranked against those of the same activity front and the same
    set of endpoints alone; other sets can't be compared. physical: molecular weight, logP, polar surface, donors and
    acceptors; beyond 800, 6 or 200 in the first three, a row asks for review. Nothing missing counts as zero.
    """
    keys = F.array(*[F.lit(k) for k in sorted(directions)])
    known = F.filter(keys, lambda k: F.coalesce(F.col(predictions)[k].between(0, 1), F.lit(False)))
    turned = F.array(*[F.lit(k) for k in sorted(directions) if directions[k] == "higher"] or [F.lit("")])
    cost = lambda k: F.when(F.array_contains(turned, k), -F.col(predictions)[k]).otherwise(F.col(predictions)[k]).cast("double")
    coverage = sum((p.isNotNull().cast("int") for p in physical), F.lit(0))
    review = F.coalesce(physical[0] > 800, F.lit(False)) | F.coalesce(physical[1] > 6, F.lit(False)) | F.coalesce(physical[2] > 200, F.lit(False))
    base = rows.select(identity, F.col(front).alias("__front"), known.alias("__known"), F.flatten(F.transform(known, lambda k: F.array(cost(k), cost(k)))).alias("__costs"), (F.coalesce(verified, F.lit(False)) & (F.size(known) > 0)).alias("__ok"), (-coverage).alias("neg_coverage"), review.cast("int").alias("review"))
    ranked = pareto_depths(base.where("__ok and __front is not null").withColumn("__set", F.array_join("__known", ",")), ["__front", "__set"], identity, "__costs").select(identity, F.col("front").alias("__own"))
    joined = base.join(ranked, identity, "left")
    placed = F.col("__own").isNotNull()
    return joined.select(identity, (~F.col("__ok")).cast("int").alias("unverified"), F.when(placed, -F.size("__known")).otherwise(0).alias("neg_endpoints"), F.coalesce("__own", F.lit(0)).alias("own_front"), "neg_coverage", "review")


def select_candidates(rows: DataFrame, identity: str, molecule: str, priority: list[str], vector: str, k: int = 8) -> DataFrame:
    """(identity, pick): the first by priority; among equals the one least similar to the picks before it.

    A row without a vector is never novel: it stands behind equals that have one, as soon as a pick has one. Rows of a
    molecule that was picked leave. Each pick is one top-one pass over the rows, which are never collected.
    """
    base = rows.select(F.col(identity).alias("id"), F.col(molecule).alias("m"), *priority, F.col(vector).cast("array<double>").alias("v"))
    base = base.where(" and ".join(f"{p} is not null" for p in priority[:1]) or "true").withColumn("norm", F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)))
    picks: list[Row] = []
    for _ in range(k):
        near = [F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in p["v"]]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.col("norm") * p["norm"], F.lit(0.0)) for p in picks if p["v"] is not None]
        similar = [F.col("v").isNull(), F.round(near[0] if len(near) == 1 else F.greatest(*near), 12)] if near else []
        left = base.where(~F.col("m").isin([p["m"] for p in picks])) if picks else base
        best = left.orderBy(*priority, *similar, "id").first()
        if best is None:
            break
        picks.append(best)
    kind = rows.schema[identity].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(p["id"], n + 1) for n, p in enumerate(picks)], f"{identity} {kind}, pick long")


def diverse_top(pool: DataFrame, identity: str, quality: str, vector: str, k: int = 8, scaffold: str | None = None) -> DataFrame:
    """(identity, pick, score): k rows, each the best of .8 quality + .2 novelty given the picks before it.

    Each pick is one pass over the pool: a top-one aggregate over rows that carry their nearest
    similarity to the picks. Ties take the smallest identity. The pool is never collected.
    """
    spark = pool.sparkSession
    base = pool.select(F.col(identity).alias("id"), F.col(quality).cast("double").alias("q"), F.col(vector).cast("array<double>").alias("v"), (F.col(scaffold) if scaffold else F.lit(None)).cast("string").alias("s"))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    base = base.withColumn("norm", norm)
    picks: list[tuple] = []
    for n in range(k):
        near, seen = F.lit(0.0), F.lit(False)
        for _, v, size, s, _ in picks:
            dot = F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in v]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
            near = F.greatest(near, F.least(F.lit(1.0), dot / F.nullif(F.col("norm") * size, F.lit(0.0))))
            seen = seen | (F.col("s") == F.lit(s) if s is not None else F.lit(False))
        fresh = F.when(F.col("s").isNull(), 1 - near).otherwise(0.7 * (1 - near) + 0.3 * (~seen).cast("double"))
        score = 0.8 * F.col("q") + 0.2 * 100 * (F.lit(1.0) if not picks else fresh)
        left = base.where(~F.col("id").isin([p[0] for p in picks])) if picks else base
        best = left.select("id", "v", "norm", "s", score.alias("score")).orderBy(F.desc("score"), "id").first()
        if best is None:
            break
        picks.append((best["id"], best["v"], best["norm"], best["s"], best["score"]))
    kind = pool.schema[identity].dataType.simpleString()
    return spark.createDataFrame([(p[0], n + 1, float(p[4])) for n, p in enumerate(picks)], f"{identity} {kind}, pick long, score double")
