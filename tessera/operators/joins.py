"""Joins beyond equality: points in cells, headings, row order, fuzzy identifiers, alternatives.

Each has an equality key (page, document, bucket), so none plans a nested loop over everything.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import cut, in_file_order


def squares(boxes: DataFrame, size: float) -> DataFrame:
    """Each box once for every square of the plane that it reaches, numbered __i, __j."""
    upto = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.greatest(F.floor(F.col(lo) / size), F.ceil(F.col(hi) / size) - 1)))
    return boxes.withColumn("__i", upto("x0", "x1")).withColumn("__j", upto("y0", "y1"))


def points_in_cells(tokens: DataFrame, cells: DataFrame, keys: list[str], size: float = 64.0) -> DataFrame:
    """Tokens (x, y) with the half-open cell (x0 <= x < x1, y0 <= y < y1) of their page that owns them.

    Cells are cut into squares of the given size, which join by equality; so a page with very
    many cells does not compare each token with all of them.
    """
    placed = tokens.withColumn("__i", F.floor(F.col("x") / size)).withColumn("__j", F.floor(F.col("y") / size))
    inside = "x >= x0 AND x < x1 AND y >= y0 AND y < y1"
    return placed.join(squares(cells, size), [*keys, "__i", "__j"]).where(inside).drop("__i", "__j")


def levelled(boxes: DataFrame) -> DataFrame:
    """Boxes with __level: the least power of two that is as long as their longer side."""
    longer = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return boxes.withColumn("__level", F.ceil(F.log2(F.greatest(longer.cast("double"), F.lit(2.0**-20)))).cast("int"))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rectangle pairs of one page that overlap by more than an edge; columns of b carry b_.

    Two boxes meet in the squares that are as large as the larger one, of which either reaches four at most; so what is compared lies
    near each other, at any scale and mixture of sizes. A pair counts in the square that holds the corner of its overlap alone.
    """
    own, other = levelled(a), levelled(b)
    other = other.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys], F.col("__level").alias("__b_level"))
    levels = own.select(*keys, F.col("__level").alias("__at")).distinct(), other.select(*keys, F.col("__b_level").alias("__at")).distinct()
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def reached(boxes: DataFrame, prefix: str, at: Column) -> DataFrame:
        size = F.pow(F.lit(2.0), at)
        upto = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.greatest(F.floor(F.col(lo) / size), F.ceil(F.col(hi) / size) - 1)))
        placed = boxes.withColumn("__i", upto(f"{prefix}x0", f"{prefix}x1")).withColumn("__j", upto(f"{prefix}y0", f"{prefix}y1"))
        return placed.withColumn("__at", at).repartition(n, *keys, "__at", "__i", "__j")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = left.drop("__level").join(right.drop("__b_level"), [*keys, "__at", "__i", "__j"]).where("x0 < b_x1 AND b_x0 < x1 AND y0 < b_y1 AND b_y0 < y1")
        size = F.pow(F.lit(2.0), F.col("__at"))
        corner = (F.floor(F.greatest("x0", "b_x0") / size) == F.col("__i")) & (F.floor(F.greatest("y0", "b_y0") / size) == F.col("__j"))
        return pairs.where(corner).drop("__at", "__i", "__j")

    # b's boxes at every level of a's that is not under their own, and a's at every greater one of b's
    larger = met(reached(own, "", F.col("__level")), reached(other.join(levels[0], keys).where("__b_level <= __at"), "b_", F.col("__at")))
    smaller = met(reached(own.join(levels[1], keys).where("__level < __at"), "", F.col("__at")), reached(other, "b_", F.col("__b_level")))
    return larger.unionByName(smaller)


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Each row with the latest value at or before it: a heading owns what follows until the next."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def carried_in_parts(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``carried`` where one key may hold any share of all rows: no task gets more of it than of others.

    One range-partitioned sort, written; a part carries within itself, and what a key brings along from earlier parts comes from a row
    for each part that it goes on in.
    """
    sorted_ = cut(rows.withColumn(name, value).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order), "ordered")
    placed = sorted_.select("*", F.col("_metadata.file_path").alias("__part"), F.col("_metadata.row_index").alias("__index"))
    within = Window.partitionBy("__part", *keys).orderBy("__index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumn("__own", F.last(name, ignorenulls=True).over(within))
    ends = placed.groupBy("__part", *keys).agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("__index"))).alias("__last"), F.count(name).alias("__n"))
    ends = ends.withColumn("__last", F.when(F.col("__n") > 0, F.col("__last")))
    # parts follow each other by name; of a key only those are looked at that it shares with others
    alike = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    several = ends.groupBy(*keys).agg(F.count("*").alias("__parts")).where("__parts > 1")
    before = Window.partitionBy(*keys).orderBy(F.length("__part"), "__part").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.alias("e").join(several.alias("s"), alike("e", "s"), "left_semi").withColumn("__brought", F.last("__last", ignorenulls=True).over(before))
    joined = own.alias("a").join(brought.alias("b"), [F.col("a.__part") == F.col("b.__part"), *alike("a", "b")], "left")
    kept = [F.col(f"a.{c}") for c in rows.columns if c != name]
    return joined.select(*kept, F.coalesce("a.__own", "b.__brought").alias(name))


def numbered_in_parts(rows: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 1 within their key, in an order, where one key may hold any share of all rows: places of one written sort, less where the key begins."""
    placed = in_file_order(cut(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order), "ordered"), "__place")
    begins = placed.groupBy(*keys).agg(F.min("__place").alias("__begin"))
    alike = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = placed.alias("a").join(begins.alias("b"), alike)
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("a.__place") - F.col("b.__begin") + 1).alias(name))


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with right's value at the greatest time not after its own, by one sort of both; ties take right's row."""
    a = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    upto = Window.partitionBy(*keys).orderBy(at, "__side", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(upto)).where("__side = 1").drop("__side", "__v")


def in_order(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The k-th row of each key on the left with the k-th on the right; unpaired rows keep nulls."""
    number = lambda df, order: df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "ordinal"], "full")


def concatenated(rows: DataFrame, keys: list[str], order: list[str], value: str, separator: str = " | ") -> DataFrame:
    """Repeats of a key joined in source order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, value)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[value]), separator).alias(value))


def with_provenance(rows: DataFrame, cells: DataFrame, keys: list[str], field: str, value: str) -> DataFrame:
    """Each value with the source cells that hold it (field and value equal), or once without any."""
    return rows.join(cells, [*keys, field, value], "left")


def declared(rows: DataFrame, declarations: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fill only missing fields from declarations; a declaration against a known field is a conflict."""
    side = declarations.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    out = rows.join(side, keys, "left")
    conflict = F.lit(False)
    for f in fields:
        conflict = conflict | F.coalesce(F.col(f) != F.col(f"__{f}"), F.lit(False))
    out = out.withColumn("conflict", conflict)
    for f in fields:
        out = out.withColumn(f, F.coalesce(f, f"__{f}"))
    return out.drop(*[f"__{f}" for f in fields])


def exact_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equality join that refuses repeated keys on either side."""
    once = lambda df: df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    single = lambda df: df.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("a key is repeated"))).otherwise(F.lit(True))).drop("__n")
    return single(once(left)).join(single(once(right)), keys)


#: Strings up to this length meet by what deletions leave of them, longer ones by parts.
SHORT = 32


def shortened(text: Column, most: int) -> Column:
    """A string and all that it becomes by deleting up to so many characters."""
    drop = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    less = lambda several: F.array_distinct(F.flatten(F.transform(several, drop)))
    # get of transform: each level is made once
    upto = lambda several, k: several if k == 0 else F.get(F.transform(F.array(less(several)), lambda made: F.concat(several, upto(made, k - 1))), F.lit(0))
    return F.array_distinct(upto(F.array(text), most))


def fuzzy_candidates(observed: DataFrame, known: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """(keys, original, suggested, distance): identifiers within an edit distance.

    Two strings within d edits become equal by deleting up to d characters of each: short ones meet by hashes of what is left, so a
    beginning that all share brings none together. Pairs with a longer one share, cut into d + 1 parts, at least one part whole, at most d
    places away. Levenshtein with a bound verifies.
    """
    n = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # strings are small, what is made of them is not
    seen = observed.select(*keys, "original").repartition(n, *keys, "original").distinct().withColumn("__n", F.length("original"))
    wanted = known.select(*keys, "suggested").repartition(n, *keys, "suggested").distinct().withColumn("__m", F.length("suggested"))
    left = lambda df, c, n: df.where(F.col(n) <= SHORT).select(*keys, c, F.explode(F.transform(shortened(F.col(c), most), lambda s: F.xxhash64(s))).alias("p"))
    # merge: what is exploded looks small beforehand, and would be broadcast
    near = left(seen, "original", "__n").hint("merge").join(left(wanted, "suggested", "__m"), [*keys, "p"]).select(*keys, "original", "suggested")
    long = by_parts(seen.where(F.col("__n") > SHORT - most), wanted.where(F.col("__m") > SHORT - most), keys, most)
    long = long.where((F.length("original") > SHORT) | (F.length("suggested") > SHORT))
    distance = F.levenshtein("original", "suggested", most)
    return near.unionByName(long).withColumn("distance", distance).where("distance >= 0").distinct()


def by_parts(seen: DataFrame, wanted: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, original, suggested): those that share a part at most so many places away."""
    cut = lambda k: F.floor(F.col("__n") * k / (most + 1)).cast("int")
    pieces = F.array(*[F.struct(F.lit(k).alias("k"), F.col("__n").alias("n"), F.substr("original", cut(k) + 1, cut(k + 1) - cut(k)).alias("s")) for k in range(most + 1)])
    left = seen.select(*keys, "original", F.explode(pieces).alias("p"))
    shifts = F.explode(F.sequence(F.greatest(F.col("__m") - most, F.lit(0)), F.col("__m") + most))
    slots = wanted.select(*keys, "suggested", "__m", shifts.alias("__n"))
    windows = F.array(*[F.struct(F.lit(k).alias("k"), F.col("__n").alias("n"), F.substr("suggested", cut(k) + 1 + d, cut(k + 1) - cut(k)).alias("s"), (cut(k) + d >= 0).alias("ok")) for k in range(most + 1) for d in range(-most, most + 1)])
    right = slots.select(*keys, "suggested", F.explode(windows).alias("w")).where("w.ok").select(*keys, "suggested", F.struct("w.k", "w.n", "w.s").alias("p")).distinct()
    return left.hint("merge").join(right, [*keys, "p"]).select(*keys, "original", "suggested")


def greedy(wants: DataFrame, document: str) -> DataFrame:
    """(document, original, suggested, distance): each original, ascending, takes its nearest suggestion that no earlier one has taken.

    All ask for their nearest at once; who asks later than another for the same gives it up for good, and asks for the next. As
    every suggestion prefers the earlier one, what stays is what taking turns gives. A round is two groupings and a join, written.
    """
    left, n = cut(wants.select(document, "original", "suggested", "distance"), "wants"), None
    while True:
        top = left.groupBy(document, "original").agg(F.min(F.struct("distance", "suggested")).alias("b")).select(document, "original", "b.suggested", "b.distance")
        holders = top.groupBy(document, "suggested").agg(F.min("original").alias("__holder"))
        ahead = left.count()
        if ahead == n:
            return top
        before, n = left, ahead
        left = cut(before.join(holders, [document, "suggested"], "left").where("__holder IS NULL OR original <= __holder").drop("__holder"), "wants")


def reconciled(observed: DataFrame, known: DataFrame, document: str, prefix: str = "Cpd-") -> DataFrame:
    """Corrections (document, original, suggested, distance, confidence, kind) of misread identifiers.

    observed(document, cpd, n): how often each was read; known(document, cpd). First each extra
    identifier, ascending, takes the nearest unused missing one (``greedy``); then each missing one still unused
    lists candidates among all observed ones. No document's pairs meet in one task.
    """
    seen = observed.select(document, F.col("cpd").alias("original"), "n")
    wanted = known.select(document, F.col("cpd").alias("suggested")).distinct()
    missing = wanted.join(seen.select(document, F.col("original").alias("suggested")), [document, "suggested"], "left_anti")
    extra = seen.join(wanted.select(document, F.col("suggested").alias("original")), [document, "original"], "left_anti").select(document, "original").distinct().withColumn("extra", F.lit(True))
    pairs = fuzzy_candidates(seen, missing, [document])
    rows = cut(pairs.join(seen, [document, "original"]).join(extra, [document, "original"], "left").withColumn("extra", F.coalesce("extra", F.lit(False))), "candidates")
    taken = cut(greedy(rows.where("extra"), document), "taken")
    free = rows.join(taken.select(document, "suggested"), [document, "suggested"], "left_anti").join(taken.select(document, "original"), [document, "original"], "left_anti").where("extra OR n > 1")
    best = free.groupBy(document, "suggested").agg(F.min(F.struct("distance", "original", "n")).alias("b")).select(document, "b.original", "suggested", "b.distance", F.lit("missing").alias("kind"), (F.col("b.n") > 1).alias("repeated"))
    found = taken.select(document, "original", "suggested", "distance", F.lit("extra").alias("kind"), F.lit(False).alias("repeated")).unionByName(best)

    @F.pandas_udf("double")
    def confidence(original: pd.Series, suggested: pd.Series, distance: pd.Series, kind: pd.Series, repeated: pd.Series) -> pd.Series:
        def score(o: str, s: str, d: int, k: str, again: bool) -> float:
            x, y = ["".join(c for c in t if c.isdigit()) for t in (o, s)]
            bonus = 0.15 * bool(x and y and (x in y or y in x)) + 0.1 * bool(again) if k == "missing" else 0.0
            return round(min(1.0, 1 - d / max(len(o), len(s)) + bonus + 0.1 * (o.startswith(prefix) and s.startswith(prefix))), 2)

        return pd.Series([score(*r) for r in zip(original, suggested, distance, kind, repeated)], dtype="float64")

    return found.select(document, "original", "suggested", "distance", confidence("original", "suggested", "distance", "kind", "repeated").alias("confidence"), "kind")


def one_to_one(claims: DataFrame, label: str, structure: str, primary: Column) -> DataFrame:
    """Claims with their verdict: an owner among primary claims, a label among all, or accepted (first of each pair)."""
    structures = claims.where(primary).groupBy(label).agg(F.count_distinct(structure).alias("__s"))
    labels = claims.groupBy(structure).agg(F.count_distinct(label).alias("__l"))
    joined = claims.join(structures, label, "left").join(labels, structure, "left")
    verdict = F.when(F.col("__s") > 1, "ambiguous_compound_owner").when(F.col("__l") > 1, "ambiguous_structure_owner").otherwise("accepted")
    return joined.withColumn("verdict", verdict).drop("__s", "__l")


def continued(links: DataFrame, depth: int = 64) -> DataFrame:
    """(node, root, steps): follow each table fragment (node, parent) back to its first page; deeper chains are refused.

    Each round doubles the steps that a link goes back, so there are as many rounds as the deepest chain has binary digits; a round is two joins
    on nodes, written, whatever the number of rows.
    """
    ahead = links.where("parent IS NOT NULL").select("node", F.col("parent").alias("at")).distinct()
    # ended: the longest chains that end within so many steps; ahead: where a chain is after exactly so many
    ahead, reach = cut(ahead, "chains"), 1
    first = ahead.alias("l").join(ahead.select(F.col("node").alias("__n")).distinct(), F.col("at") == F.col("__n"), "left")
    ended = cut(first.where("__n IS NULL").groupBy("node").agg(F.max(F.struct(F.lit(1).alias("steps"), F.col("at").alias("root"))).alias("e")), "ended")
    while reach <= depth and not ahead.isEmpty():
        further = ahead.select("node", F.col("at").alias("__at")).join(ended.select(F.col("node").alias("__at"), F.col("e").alias("__e")), "__at").select("node", F.struct((F.col("__e.steps") + reach).alias("steps"), F.col("__e.root").alias("root")).alias("e"))
        ended = cut(ended.unionByName(further).groupBy("node").agg(F.max("e").alias("e")), "ended")
        ahead = cut(ahead.select("node", F.col("at").alias("__at")).join(ahead.select(F.col("node").alias("__at"), "at"), "__at").select("node", "at").distinct(), "chains")
        reach *= 2
    rows = ended.select("node", "e.root", "e.steps").unionByName(ahead.select("node", F.col("at").alias("root"), F.lit(reach).alias("steps")).where(F.lit(reach > depth)))
    return rows.where(F.when(F.col("steps") > depth, F.raise_error(F.lit("a chain is too deep"))).otherwise(F.lit(True)))
