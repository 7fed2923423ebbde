"""Logged conversations: collapse cumulative snapshots, then render.

A log often holds a conversation again each time that it grew. A rolling hash over turns (two
64-bit exclusive-or sums of hashes of position, role and text) names every prefix of every
conversation; one whose whole is a proper prefix of another is a snapshot and leaves by an
anti-join, and of equal ones the smallest conv_id stays. Only hashes are shuffled for that:
texts move once, for those that stay, to be rendered.

Cases: turns are ordered by turn, then role, then the text's MD5, and a null turn comes first; so
turns of one number have one order whatever the input's. Repeated rows are turns of their own. Null roles
and texts are empty; rows without a conv_id are left out; very long texts are hashed and rendered
whole; an empty table gives an empty table; other columns are ignored. One conversation is ordered, and rendered
to its one text, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def turns_of(log: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return log.where("conv_id is not null").select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, p, q): the rolling hash of each conversation's first turns."""
    rows = turns.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.reverse("text"), "role").alias("b"), F.md5(F.col("text").cast("binary")).alias("m"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "m")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id")))
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = [F.expr(f"bit_xor(xxhash64(place, {c}, m))").over(upto).alias(n) for c, n in (("a", "p"), ("b", "q"))]
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), "n_turns", *rolled)


def maximal(log: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that stay."""
    marks = cut(prefixes(turns_of(log)), "prefixes")
    begun = marks.where("place < n_turns").select("place", "p", "q").distinct()
    whole = marks.where("place = n_turns").groupBy("place", "n_turns", "p", "q").agg(F.min("conv_id").alias("conv_id"))  # equal ones are one row from here on
    return whole.join(begun, ["place", "p", "q"], "left_anti").select("conv_id", "n_turns")


def rendered(turns: Column, opening: str = "<|{}|>\n", closing: str = "<|end|>\n") -> Column:
    """One text of an ordered array of (role, text): each turn between its role's mark and an end mark."""
    before, after = opening.split("{}")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit("\n" + closing))), "")


def format_chats(log: DataFrame) -> DataFrame:
    """conv_id, n_turns, chat: the maximal conversations, rendered."""
    turns = turns_of(log).join(maximal(log), "conv_id")
    grouped = turns.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("set"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("m"), "text"))).alias("turns"))
    return grouped.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), rendered(F.col("turns")).alias("chat"))
