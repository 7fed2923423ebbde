"""Repair of damaged conversations: the cheapest edits after which user and assistant take turns.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant.
Keeping a turn costs 0, a new role (user or assistant) 1, deleting 2, inserting an empty turn 5; blank and
repeated turns must go, and a truncated turn that stays costs 5. What has been written so far is one of four
states: nothing, a system turn, a user's turn last, a pair complete.

The least costs come from a dynamic program over tensors with time first: chunks of turns are bucketed by
length, a bucket is an array (turns, chunks), and each of its turns updates the state costs of all chunks
at once, backwards. The stored costs then lead all chunks forward through their edits, again a turn at
a time; of equally cheap edits the one with the first initial (D, I, K, R) is taken, which gives the
ASCII-least list, since an initial and a state determine the next state.

A conversation longer than ``CHUNK`` turns is several chunks, so one of any length never meets in one task:
1. ``transfers`` gives each chunk's least cost from every state to every state (min-plus),
2. ``ends`` chains these backwards, a row of 16 numbers for a chunk, to the costs behind each chunk,
3. with these each chunk is traced from all four states, and
4. ``entries`` chains the states that they lead to, forwards.
Shorter ones (nearly all) go through step 3 alone. Duplicates are found by grouping hashes, with partial
counts, places by one sort of the table; all joins are between plain shuffles, which adaptive execution splits.

Cases: nulls in conv_id, role or text count as one space where they are written or hashed; a null conv_id
is a conversation; null turns come first; rows of one turn are in the order of role, then of the text's
SHA-256; equal rows are repeated turns; conversations without a row left are given with zeros; very long texts
are handled whole; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import in_file_order

from .common import cut, slices

#: Turns of a chunk.
CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, PAIR = range(4)
FAR = 1 << 40
#: The state after a system, user or assistant turn (0, 1, 2), or none.
AFTER = np.array([[SYSTEM, USER, -1], [-1, USER, -1], [-1, -1, PAIR], [-1, USER, -1]])
#: The state after the one turn that may be written next by inserting or by a new role, and its role.
NEXT = np.array([USER, USER, PAIR, USER])
ROLES = ["user", "user", "assistant", "user"]
#: What is left to pay when all turns are done.
DONE = np.array([0, 2 * INSERT, INSERT, 0])
#: Bits of a turn's code above its initial (0 to 2 for s, u, a; 3 for others).
GOES, TRUNCATED = 4, 8
SPACE, WORD = " \t\n\x0b\f\r", "[^\\x20\\x09-\\x0D]"


def named(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(log: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a log after the damage that each row's key draws: it is dropped, emptied, robbed of its ends of
    sentences, repeated or given to the user."""
    draw = F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")), F.lit(20))
    rows = log.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def placed(turns: DataFrame) -> DataFrame:
    """turns with ``pos`` (from 0 within the conversation), ``n_turns`` and each row's fault: blank, duplicate, truncated or none."""
    key = ["conv_id", "turn", "role", "digest", "row"]  # the row deals out any number of equal rows
    rows = turns.withColumn("digest", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id())
    ordered = in_file_order(cut(rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("row"), "turns"), "place")
    sizes = ordered.groupBy("conv_id").agg(F.min("place").alias("start"), F.count("*").alias("n_turns"))
    firsts = ordered.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = lambda a, b, names: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    found = ordered.alias("a").join(firsts.alias("b"), same("a", "b", ["conv_id", "role", "digest"]), "left").select("a.*", "b.first")
    found = found.alias("a").join(sizes.alias("b"), same("a", "b", ["conv_id"])).select("a.*", "b.start", "b.n_turns")
    blank = ~F.col("text").rlike(WORD)
    whole = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, F.lit("blank")).when(F.col("place") > F.col("first"), F.lit("duplicate")).when(~whole, F.lit("truncated"))
    return found.select("conv_id", "turn", "role", "text", (F.col("place") - F.col("start")).alias("pos"), "n_turns", fault.alias("fault"))


def chunks(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, n_chunks, codes: a byte a turn, in order."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(F.col("fault").isin("blank", "duplicate"), GOES).when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    at = rows.select("conv_id", F.floor(F.col("pos") / CHUNK).alias("chunk"), F.ceil(F.col("n_turns") / CHUNK).alias("n_chunks"), F.struct(F.col("pos"), code.cast("byte").alias("code")).alias("c"))
    return at.groupBy("conv_id", "chunk", "n_chunks").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["code"]).alias("codes"))


def costs(codes: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes (turns, n), behind (n, k, 4): least costs to go (turns + 1, n, k, 4), before and after the inserts at that turn are allowed for."""
    turns = len(codes)
    best = np.empty((turns + 1, *behind.shape), np.int64)
    best[turns] = behind
    for t in range(turns - 1, -1, -1):
        row, after = codes[t], best[t + 1]
        stays = np.where(row & GOES, FAR, np.where(row & TRUNCATED, CUT, 0))[:, None, None]
        to = np.vstack([AFTER.T, np.full(4, -1)])[row & 3]  # (n, 4): the state that keeping leads to
        kept = np.where(to[:, None, :] < 0, FAR, np.take_along_axis(after, np.broadcast_to(np.maximum(to, 0)[:, None, :], after.shape), 2) + stays + KEEP)
        now = np.minimum(np.minimum(after + DELETE, kept), after[..., NEXT] + stays + REROLE)
        for _ in range(2):
            now = np.minimum(now, now[..., NEXT] + INSERT)
        best[t] = now
    return best


def traced(codes: np.ndarray, best: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edits of n chunks that start in these states: letters (3 * turns + 2, n), 0 where none, and the states that they end in.

    best (turns + 1, n, 4); last (n): whether the conversation ends with the chunk, so that what is missing is inserted.
    """
    turns, n = codes.shape
    out, each = np.zeros((3 * turns + 2, n), np.uint8), np.arange(n)
    for t in range(turns):
        row, to_go, after = codes[t], best[t], best[t + 1]
        open_ = np.ones(n, bool)
        for step in range(3):
            left = to_go[each, state]
            free = open_ & (after[each, state] + DELETE == left)
            insert = open_ & ~free & (to_go[each, NEXT[state]] + INSERT == left)
            rest = open_ & ~free & ~insert
            kept = np.where((row & 3) < 3, AFTER[state, np.minimum(row & 3, 2)], -1)
            stays = np.where(row & GOES, FAR, np.where(row & TRUNCATED, CUT, 0))
            keep = rest & (kept >= 0) & (after[each, np.maximum(kept, 0)] + stays + KEEP == left)
            out[3 * t + step] = np.select([free, insert, keep, rest], [ord("D"), ord("I"), ord("K"), ord("R")], 0)
            state = np.select([insert | (rest & ~keep), keep], [NEXT[state], kept], state)
            open_ = insert
    for step in range(2):
        short = last & ((state == SYSTEM) | (state == USER))
        out[3 * turns + step] = np.where(short, ord("I"), 0)
        state = np.where(short, NEXT[state], state)
    return out, state


def buckets(codes: list[list[int]], limit: int = 1 << 20) -> Iterator[tuple[list[int], np.ndarray]]:
    """Indexes of the lists of one length, and their codes with time first; at most about ``limit`` codes at once."""
    by = defaultdict(list)
    for k, c in enumerate(codes):
        by[len(c)].append(k)
    for n, found in by.items():
        size = max(1, limit // max(n, 1))
        for a in range(0, len(found), size):
            part = found[a : a + size]
            yield part, np.array([codes[k] for k in part], np.int64).reshape(len(part), n).T


def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values.tolist(), pa.list_(kind))


def transfers(parts: DataFrame) -> DataFrame:
    """conv_id, chunk, costs: least cost from each state (row) to each (column) within a chunk."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(2).to_pylist()
            found = np.empty((len(codes), 16), np.int64)
            for index, block in buckets(codes, 1 << 18):
                ends = np.where(np.eye(4, dtype=bool), 0, FAR)[None].repeat(len(index), 0)
                found[index] = np.minimum(costs(block, ends)[0], FAR).transpose(0, 2, 1).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed(found, pa.int64())], ["conv_id", "chunk", "costs"])

    return parts.select("conv_id", "chunk", "codes").mapInArrow(each, "conv_id long, chunk long, costs array<long>")


def chained(summaries: DataFrame, value: str, chain, kind: str) -> DataFrame:
    """conv_id, chunk and what ``chain`` makes of a conversation's summaries, in order; a row of a few numbers for each chunk."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = chain([c["v"] for c in found])
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(made), pa.int64()), pa.array([c["chunk"] for c in found], pa.int64()), pa.array(made)], ["conv_id", "chunk", "made"])

    rows = summaries.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", F.col(value).alias("v")))).alias("found"))
    return rows.mapInArrow(each, f"conv_id long, chunk long, made {kind}")


def ends(found: list[list[int]]) -> list[list[int]]:
    """The costs to go behind each chunk, from the transfers of all."""
    made, behind = [], DONE
    for c in reversed(found):
        made.append(behind.tolist())
        behind = np.minimum((np.array(c).reshape(4, 4) + behind).min(1), FAR)
    return made[::-1]


def entries(found: list[list[int]]) -> list[int]:
    """The state before each chunk, from the states that each leads to."""
    made = [NOTHING]
    for c in found[:-1]:
        made.append(c[made[-1]])
    return made


def edits(parts: DataFrame) -> DataFrame:
    """conv_id, chunk, entry, cost (to go, from that state), audit: the edits of every chunk."""
    parts = cut(parts, "chunks")
    several = parts.where("n_chunks > 1")
    behind = chained(transfers(several), "costs", ends, "array<long>").withColumnRenamed("made", "behind")
    keys = lambda a, b: [F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")), F.col(f"{a}.chunk") == F.col(f"{b}.chunk")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, given = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            last = np.array(batch.column(4).to_pylist(), bool)
            audits, cost, to = [None] * len(codes), np.empty((len(codes), 4), np.int64), np.empty((len(codes), 4), np.int64)
            for index, block in buckets(codes, 1 << 18):
                best = costs(block, np.array([given[k] or DONE for k in index], np.int64)[:, None, :])[:, :, 0]
                cost[index] = best[0]
                found = [traced(block, best, np.full(len(index), s), last[index]) for s in range(4)]
                to[index] = np.stack([f[1] for f in found], 1)
                for j, k in enumerate(index):
                    audits[k] = [f[0][:, j][f[0][:, j] > 0].tobytes().decode() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed(cost, pa.int64()), listed(to, pa.int64()), pa.array(audits, pa.list_(pa.string()))], ["conv_id", "chunk", "costs", "leads", "audits"])

    joined = parts.alias("a").join(behind.alias("b"), keys("a", "b"), "left")
    rows = joined.select("a.conv_id", "a.chunk", "a.codes", "b.behind", (F.col("a.chunk") == F.col("a.n_chunks") - 1).alias("last"))
    found = cut(rows.mapInArrow(each, "conv_id long, chunk long, costs array<long>, leads array<long>, audits array<string>"), "edits")
    long_ones = found.alias("a").join(several.select("conv_id").distinct().alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left_semi")
    entry = chained(long_ones, "leads", entries, "long")
    rows = found.alias("a").join(entry.alias("b"), keys("a", "b"), "left").select("a.*", F.coalesce("b.made", F.lit(0)).cast("int").alias("entry"))
    return rows.select("conv_id", "chunk", "entry", F.col("costs")[F.col("entry")].alias("cost"), F.col("audits")[F.col("entry")].alias("audit"))


def steps(found: DataFrame) -> DataFrame:
    """conv_id, pos, nth, role: the turns of the repaired conversations; a null role is the turn's own, and nth orders them, those of one turn too.

    An inserted turn has the pos of the turn that it stands before, and ``own`` false.
    """

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())

    def written(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*made), kinds)], ["conv_id", "pos", "nth", "role", "own"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for conv, chunk, state, audit, codes in zip(*(batch.column(k).to_pylist() for k in range(5))):
                made += [(conv, *turn) for turn in walked(chunk * CHUNK, state, audit, codes)]
                if len(made) >= 4 * CHUNK:
                    yield written(made)
                    made = []
            if made:
                yield written(made)

    return found.select("conv_id", "chunk", "entry", "audit", "codes").mapInArrow(each, "conv_id long, pos long, nth int, role string, own boolean")


def walked(pos: int, state: int, audit: str, codes: list[int]) -> list[tuple[int, int, str | None, bool]]:
    """(pos, nth, role, own) of the turns that edits write."""
    made, k, nth = [], 0, 0
    for edit in audit:
        if edit == "I":
            made.append((pos + k, nth, ROLES[state], False))
            nth += 1
        else:
            if edit != "D":
                made.append((pos + k, nth, ROLES[state] if edit == "R" else None, True))
            k, nth = k + 1, 0
        if edit in "IR":
            state = int(NEXT[state])
        elif edit == "K":
            state = int(AFTER[state, codes[k - 1] & 3])
    return made


def repaired(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns as placed, edits by chunk, repaired turns conv_id, pos, nth, role, text) of a log."""
    rows = cut(placed(log), "placed")
    parts = cut(chunks(rows), "codes")
    both = lambda a, b, *names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    found = cut(edits(parts), "audits")
    written = steps(found.alias("a").join(parts.alias("b"), both("a", "b", "conv_id", "chunk")).select("a.*", "b.codes"))
    texts = written.alias("a").join(rows.alias("b"), [*both("a", "b", "conv_id"), F.col("a.pos") == F.col("b.pos"), F.col("a.own")], "left")
    return rows, found, texts.select("a.conv_id", "a.pos", "a.nth", F.coalesce("a.role", "b.role").alias("role"), F.coalesce("b.text", F.lit("")).alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of a conversation's ``role:text`` lines. A hash is read in order, so one conversation is one task's, but never in memory at once."""
    rows = turns.select("conv_id", "pos", "nth", F.concat("role", F.lit(":"), "text").alias("line"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = (), None
        for whole in batches:
            for batch in slices(whole):
                done = []
                for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if (conv,) != now:
                        if now:
                            done.append((now[0], digest.hexdigest()))
                        now, digest = (conv,), hashlib.sha256(line.encode())
                    else:
                        digest.update(b"\n" + line.encode())
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv_id", "sha"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "sha"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "nth").select("conv_id", "line").mapInArrow(each, "conv_id long, sha string")


def illegal_pairs(rows: DataFrame) -> DataFrame:
    """conv_id, illegal: adjacent turns whose roles' initials are not su, ua or au; by joining each turn with the one before, which deals a long conversation out."""
    initial = F.substring("role", 1, 1)
    one = rows.select("conv_id", "pos", initial.alias("here"))
    two = rows.select("conv_id", (F.col("pos") + 1).alias("pos"), initial.alias("before"))
    pairs = one.alias("a").join(two.alias("b"), [F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), F.col("a.pos") == F.col("b.pos")])
    return pairs.groupBy("a.conv_id").agg(F.count_if(~F.concat("before", "here").isin("su", "ua", "au")).alias("illegal"))


def audited(log: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conv_id of ``log``: gaps, faults, cost, audit and repaired_sha256 of its ``turns``."""
    rows, found, fixed = repaired(turns)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    faults = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    counted = rows.groupBy("conv_id").agg(gaps.alias("gaps"), *faults)
    audits = found.groupBy("conv_id").agg(F.sum(F.when(F.col("chunk") == 0, F.col("cost"))).alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda c: c["audit"]), "").alias("audit"))
    made = log.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for df in (counted, illegal_pairs(rows), audits, digests(fixed)):
        right = df.withColumnRenamed("conv_id", "_other")
        made = made.join(right, F.col("conv_id").eqNullSafe(F.col("_other")), "left").drop("_other")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return made.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
