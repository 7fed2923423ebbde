"""JSON whose repeated parts are references into a catalogue: checked as a whole, then expanded level by level.

A reference is an object of one member, {"$shared": key} (with "$readonly": true as a second one for a
view of a source); {"$literal": {...}} holds an object that only looks like one. A catalogue's key is the SHA-256 of
the text that its part becomes when it is expanded, so a part cannot change without being noticed.

Parts may refer to parts. A part's level is one more than the highest of those that it refers to: levels, expanded
sizes and heights come from joins over references alone, one round a level, before any text is put
together, so a catalogue that would grow without bound is refused while it is small. A graph is refused whole,
for the first of these reasons: a reference without a part, a part that is nothing but a reference, a
cycle, too much depth, too large a text, a part that nothing reaches, other content than the key says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, release

#: A reference in compact JSON, outside a literal object. In a string its quotes would be escaped.
REFERENCE = r'(?<!\{"\$literal":)\{"\$shared":"([^"\\]*)"(?:,"\$readonly":true)?\}'
LITERAL = r'\{"\$literal":(\{"\$shared":"[^"\\]*"(?:,"\$readonly":true)?\})\}'
STRING = r'"(?:[^"\\]++|\\.)*+"'
#: Levels of brackets, and bytes of one expanded text.
DEEPEST, LARGEST = 256, 512 * 1024 * 1024
REASONS = ("missing_reference", "alias_only", "cycle", "depth", "size", "unreachable", "identity")


def nesting(text: Column) -> Column:
    """(most, now): how deep brackets nest in a piece of JSON, and how many stay open behind it."""
    marks = F.regexp_replace(F.regexp_replace(text, STRING, ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("most"), F.lit(0).alias("now"))

    def step(at: Column, c: Column) -> Column:
        now = at["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(F.greatest(at["most"], now).alias("most"), now.alias("now"))

    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), start, step)


def references(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, to, depth): each reference of the texts (keys, value), and how many brackets are open where it stands."""
    pieces = F.transform(F.split("value", REFERENCE, -1), nesting)
    opened = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda n, p: n + p["now"])
    found = F.transform(F.regexp_extract_all("value", F.lit(REFERENCE), F.lit(1)), lambda k, i: F.struct(k.alias("to"), opened(i).alias("depth")))
    return texts.select(*keys, F.explode(found).alias("r")).select(*keys, "r.to", "r.depth")


def checked(catalogue: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(levels: graph, key, level; refused: graph, reason; edges: graph, key, to) of a catalogue (graph, key, value) and its payloads (graph, value).

    The payload is the node with a null key; a round of the loop is a level.
    """
    nodes = cut(catalogue.select("graph", "key", "value").union(payloads.select("graph", F.lit(None).cast("string").alias("key"), "value")), "graph-nodes")
    edges = cut(references(nodes, ["graph", "key"]), "graph-edges")
    at = lambda a, b: (F.col(f"{a}.graph") == F.col(f"{b}.graph")) & F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))
    missing = edges.join(catalogue.select("graph", F.col("key").alias("to")), ["graph", "to"], "left_anti").select("graph").distinct()
    alias = catalogue.where(F.col("value").rlike(rf"^\s*{REFERENCE}\s*$")).select("graph").distinct()
    parts = catalogue.select("graph", F.col("key").alias("to"))
    unreached = parts.join(edges.select("graph", "to"), ["graph", "to"], "left_anti").select("graph").distinct()

    tokens = F.aggregate(F.transform(F.regexp_extract_all("value", F.lit(REFERENCE), F.lit(0)), F.octet_length), F.lit(0), lambda n, x: n + x)
    own = cut(nodes.select("graph", "key", (F.octet_length("value") - tokens).cast("double").alias("bytes"), nesting(F.col("value"))["most"].alias("height")), "graph-own")
    counted = edges.groupBy("graph", "key").agg(F.count_distinct("to").alias("n"))
    waiting = cut(own.alias("a").join(counted.alias("b"), at("a", "b"), "left").select("a.*", F.coalesce("b.n", F.lit(0)).alias("n")), "graph-waiting")
    known = cut(waiting.where("n = 0").select("graph", "key", "bytes", "height", F.lit(0).alias("level")), "graph-known")
    level, frontier = 0, known.count()
    while frontier and level <= DEEPEST:
        level += 1
        to = known.select("graph", F.col("key").alias("to"), F.col("bytes").alias("b"), F.col("height").alias("h"))
        sums = edges.join(to, ["graph", "to"]).groupBy("graph", "key").agg(F.sum("b").alias("b"), F.max(F.col("depth") + F.col("h")).alias("h"), F.count_distinct("to").alias("ready"))
        fresh = waiting.alias("a").join(sums.alias("s"), at("a", "s")).where("ready = n").select("a.graph", "a.key", (F.col("bytes") + F.col("b")).alias("bytes"), F.greatest("height", "h").alias("height"), F.lit(level).alias("level"))
        fresh = cut(fresh.alias("a").join(known.alias("k"), at("a", "k"), "left_anti"), "graph-level")
        frontier = fresh.count()
        both = cut(known.union(fresh), "graph-known")
        release(known, fresh)
        known = both
    cycle = waiting.alias("a").join(known.alias("k"), at("a", "k"), "left_anti").select("graph").distinct()
    deep = known.where(F.col("height") > DEEPEST).select("graph").distinct()
    large = known.where(F.col("bytes") > LARGEST).select("graph").distinct()
    found = [(missing, 0), (alias, 1), (cycle, 2), (deep, 3), (large, 4), (unreached, 5)]
    reasons = None
    for df, k in found:
        one = df.select("graph", F.lit(k).alias("k"))
        reasons = one if reasons is None else reasons.union(one)
    refused = cut(reasons.groupBy("graph").agg(F.min("k").alias("k")), "graph-refused")
    return known.select("graph", "key", "level"), refused, edges


def decoded(catalogue: DataFrame, payloads: DataFrame) -> DataFrame:
    """(graph, value, refusal): each payload with all its references expanded, or null and why the graph was refused.

    Null keys and values of the catalogue are left out; a null payload gives null.
    """
    catalogue = catalogue.where("key is not null and value is not null")
    sent = payloads
    payloads = payloads.where("value is not null")
    levels, refused, edges = checked(catalogue, payloads)
    sound = levels.join(refused, "graph", "left_anti")
    at = lambda a, b: (F.col(f"{a}.graph") == F.col(f"{b}.graph")) & F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))
    nodes = catalogue.select("graph", "key", "value").union(payloads.select("graph", F.lit(None).cast("string").alias("key"), "value"))
    nodes = cut(nodes.alias("a").join(sound.alias("b"), at("a", "b")).select("a.*", "b.level"), "graph-sound")
    whole = cut(nodes.where("level = 0").select("graph", "key", plain(F.col("value")).alias("value")), "graph-texts")
    for level in range(1, (nodes.agg(F.max("level")).first()[0] or 0) + 1):
        wanted = nodes.where(F.col("level") == level)
        texts = whole.select("graph", F.col("key").alias("to"), F.col("value").alias("text"))
        own = edges.select("graph", "key", "to").distinct().join(texts, ["graph", "to"])
        maps = own.alias("e").join(wanted.select("graph", "key").alias("w"), at("e", "w"), "left_semi").groupBy("graph", "key").agg(F.map_from_entries(F.collect_list(F.struct("to", "text"))).alias("texts"))
        between, keys = F.split("value", REFERENCE, -1), F.regexp_extract_all("value", F.lit(REFERENCE), F.lit(1))
        filled = F.array_join(F.zip_with(between, keys, lambda b, k: F.concat(plain(b), F.coalesce(F.element_at(F.col("texts"), k), F.lit("")))), "")
        made = wanted.alias("w").join(maps.alias("m"), at("w", "m")).select("w.graph", "w.key", "w.value", "m.texts").select("graph", "key", filled.alias("value"))
        both = cut(whole.union(made), "graph-texts")
        release(whole)
        whole = both
    differs = whole.where(F.col("key").isNotNull() & (F.sha2("value", 256) != F.col("key"))).select("graph", F.lit(len(REASONS) - 1).alias("k")).distinct()
    why = refused.union(differs)
    name = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("k") + 1)
    roots = whole.where("key is null").select("graph", "value").join(differs, "graph", "left_anti")
    return sent.select("graph").join(roots, "graph", "left").join(why.select("graph", name.alias("refusal")), "graph", "left")


def plain(text: Column) -> Column:
    """Literal objects without their wrapper."""
    return F.regexp_replace(text, LITERAL, "$1")
