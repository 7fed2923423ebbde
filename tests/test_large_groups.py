"""Large blocks, pages, documents and chains: nothing meets in one task, and what comes out is what it was."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import joins, pairs, ranking


def test_one_large_block_is_paired_in_many_tasks(spark, monkeypatch):
    """one key was one task."""
    monkeypatch.setattr(pairs, "CHUNK", 5)
    members = spark.createDataFrame([(1, i % 30, f"m{i}") for i in range(60)], "k int, id int, name string")
    rows = pairs.matched_pairs(members, ["k"], "id").withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows}) > 1
    expected = sorted((f"m{a}", f"m{b}") for a, b in itertools.product(range(60), repeat=2) if a % 30 != b % 30)
    assert sorted((r["reference_name"], r["candidate_name"]) for r in rows) == expected


def test_pairs_are_written_in_few_bytes(spark, tmp_path):
    """F2, F3: 4.5 million pairs of one block took over half a byte each, since references came back after 2,000 others."""
    members = spark.range(3000).selectExpr("id % 2 as k", "id * 7919 % 100003 as id", "concat('name ', id % 60) as name")
    pairs.matched_pairs(members, ["k"], "id").select("reference_id", "candidate_id", "reference_name", "candidate_name").write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 2 * 1500 * 1499
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 0.4 * 2 * 1500 * 1499


def test_rows_come_to_members_before_they_are_paired(spark):
    """names were joined to pairs, twice."""
    members = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 9)], "k int, id int")
    rows = pairs.with_rows(members, spark.createDataFrame([(i, f"n{i}") for i in range(3)], "id int, name string"), "id")
    found = pairs.matched_pairs(rows, ["k"], "id").select("reference_id", "candidate_name").collect()
    assert sorted(map(tuple, found)) == sorted((a, f"n{b}") for a in range(3) for b in range(3) if a != b)


def test_copies_are_counted_not_paired(spark):
    """400 members of four kinds make 16 rows of kinds, less what each is with itself; repeated identities too."""
    source = [("x", i if i < 390 else i - 10, i % 4) for i in range(400)] + [("y", 1, 0), ("y", 1, 3)]
    members = spark.createDataFrame(source, "k string, id int, v int")
    counts = pairs.matched_counts(members, ["k"], "id")
    assert counts.where("pairs > 0").count() <= 20
    matched = F.when(F.abs(F.col("reference_v") - F.col("candidate_v")) <= 1, "matched").otherwise("not_matched")
    outcome = F.when(F.col("candidate_v") < F.col("reference_v"), "better").when(F.col("candidate_v") > F.col("reference_v"), "worse").otherwise("equal")
    of = lambda rows, *weight: sorted(map(tuple, pairs.region_summary(rows.withColumn("m", matched).withColumn("o", outcome), ["k"], "m", "o", *weight).collect()))
    assert of(counts, "pairs") == of(pairs.matched_pairs(members, ["k"], "id"))


def test_many_chains_have_no_row_limit(spark):
    """Spark's recursion stops at a number of rows."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        links = spark.range(1, 400).select(F.col("id").alias("node"), F.when(F.col("id") % 8 != 0, F.col("id") - 1).alias("parent"))
        found = {r["node"]: (r["root"], r["steps"]) for r in joins.continued(links).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert found == {n: (n // 8 * 8, n % 8) for n in range(1, 400) if n % 8}


@pytest.mark.parametrize("depth", [1, 2, 5, 63, 64])
def test_chains_as_deep_as_allowed(spark, depth):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, depth + 1)] + [(100, depth - 1), (100, 200)], "node int, parent int")
    found = {r["node"]: (r["root"], r["steps"]) for r in joins.continued(links, depth).collect()}
    assert found == {n: (0, n) for n in range(1, depth + 1)} | {100: (0, depth) if depth > 1 else (200, 1)}


@pytest.mark.parametrize("rows, depth", [([(i, i - 1) for i in range(1, 67)], 64), ([(1, 2), (2, 1)], 64), ([(i, i - 1) for i in range(1, 5)], 3)])
def test_deeper_chains_and_circles_are_refused(spark, rows, depth):
    with pytest.raises(PySparkException, match="too deep"):
        joins.continued(spark.createDataFrame(rows, "node int, parent int"), depth).collect()


def test_boxes_of_all_sizes(spark):
    dice = random.Random(3)
    boxes = []
    for i in range(160):
        w, h = (dice.choice([0.0, 0.001, 0.5, 1.0, 3.0, 70.0, 500.0]) for _ in range(2))
        x, y = dice.choice([-40.0, 0.0, 1.0, 63.5, dice.uniform(-100, 100)]), dice.uniform(-100, 100)
        boxes.append((i % 2, i, x, x + w, y, y + h))
    df = spark.createDataFrame(boxes, "page int, id int, x0 double, x1 double, y0 double, y1 double")
    found = [(r["id"], r["b_id"]) for r in joins.overlapping(df, df, ["page"]).collect()]
    expected = [(a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and a[4] < b[5] and b[4] < a[5]]
    assert sorted(found) == sorted(expected)


def test_small_boxes_do_not_meet_in_large_squares(spark):
    """a page of 64 by 64 was one square, and one task compared all its boxes."""
    boxes = spark.range(1600).selectExpr("1 as page", "id", "id % 40 as x0", "id % 40 + 1 as x1", "id div 40 as y0", "id div 40 + 1 as y1")
    found = joins.overlapping(boxes, boxes, ["page"]).withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 1600 and len({r["task"] for r in found}) > 1


def test_shared_beginnings_bring_nothing_together(spark):
    """all identifiers with one beginning were candidates of each other."""
    text = F.lit("Cpd-1234567")
    left = {r[0] for r in spark.range(1).select(F.explode(joins.shortened(text, 2))).collect()}
    whole = "Cpd-1234567"
    assert left == {"".join(c for i, c in enumerate(whole) if i not in out) for k in range(3) for out in itertools.combinations(range(11), k)}
    assert not {x for x in left if len(x) < 9}


def test_fuzzy_candidates_of_all_lengths(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return row[-1]

    dice = random.Random(5)
    known = ["", "a", "ab", "é\U0001f600b"] + ["Cpd-" + "".join(dice.choice("01") for _ in range(dice.choice([1, 3, 6, 26, 27, 28, 29, 30, 31, 40]))) for _ in range(60)]
    seen = list(known[:10])
    for k in known * 3:
        t = list(k)
        for _ in range(dice.randrange(4)):
            at = dice.randrange(len(t) + 1)
            t[at : at + dice.randrange(2)] = dice.choice(["", "0", "1", "x"])
        seen.append("".join(t))
    found = joins.fuzzy_candidates(spark.createDataFrame([(1, s) for s in seen], "k int, original string"), spark.createDataFrame([(1, s) for s in known], "k int, suggested string"), ["k"]).collect()
    expected = {(s, k, distance(s, k)) for s in set(seen) for k in set(known) if distance(s, k) <= 2}
    assert len(found) == len(expected) and {(r["original"], r["suggested"], r["distance"]) for r in found} == expected


def test_turns_are_taken_as_one_after_another(spark):
    """the choice among a document's pairs was one task; it must be the one that turns give."""
    dice = random.Random(7)
    wants = [(d, f"e{e:02}", f"s{s:02}", dice.randrange(3)) for d in range(3) for e in range(25) for s in dice.sample(range(20), 6)]
    expected = set()
    for d in range(3):
        used = set()
        for e in sorted({w[1] for w in wants if w[0] == d}):
            free = sorted((w[3], w[2]) for w in wants if w[:2] == (d, e) and w[2] not in used)
            if free:
                used.add(free[0][1])
                expected.add((d, e, free[0][1], free[0][0]))
    top = joins.greedy(spark.createDataFrame(wants, "doc int, original string, suggested string, distance int"), "doc")
    assert {tuple(r) for r in top.select("doc", "original", "suggested", "distance").collect()} == expected


@pytest.mark.parametrize("costs", [1, 2, 3])
def test_fronts_of_intervals_in_many_blocks(spark, monkeypatch, costs):
    """each block met all earlier ones. Wide, endless and touching intervals, in blocks of nine, against every pair."""
    monkeypatch.setattr(ranking, "BLOCK", 9)
    monkeypatch.setattr(ranking, "FEW", 4)
    dice = random.Random(costs)

    def interval():
        low = float(dice.randrange(9))
        return dice.choice([[low, low]] * 3 + [[low, low + dice.choice([1, 2, 6])], [low, float("inf")], [-float("inf"), low]])

    vectors = [[x for _ in range(costs) for x in interval()] for _ in range(60)]

    def over(x, y):
        sides = [(x[k + 1] < y[k], x[k] == x[k + 1] == y[k] == y[k + 1]) for k in range(0, 2 * costs, 2)]
        return all(b or s for b, s in sides) and any(b for b, _ in sides)

    expected: dict[tuple, int] = {}
    for v in sorted(map(tuple, vectors)):
        expected[v] = expected.get(v) or 1 + max((f for w, f in expected.items() if over(w, v)), default=0)
    rows = spark.createDataFrame(list(enumerate(vectors)), "k int, v array<double>")
    found = {r["k"]: r["front"] for r in ranking.pareto_depths(rows, [], "k", "v").collect()}
    assert found == {k: expected[tuple(v)] for k, v in enumerate(vectors)}


def test_what_blocks_carry_on_is_a_row_for_each_front(spark, monkeypatch):
    """400 vectors of few fronts, in blocks of forty."""
    monkeypatch.setattr(ranking, "BLOCK", 40)
    sizes, cut = [], ranking.cut

    def counted(df, name):
        made = cut(df, name)
        sizes.extend([made.count()] if name == "carried" else [])
        return made

    monkeypatch.setattr(ranking, "cut", counted)
    rows = spark.createDataFrame([(i, float(i), float(i * 7 % 5)) for i in range(400)], "k int, x double, y double")
    found = {r["k"]: r["front"] for r in ranking.pareto_depths(rows, [], "k", [("x", "x"), ("y", "y")]).collect()}
    fronts: list[int] = []
    for i in range(400):
        fronts.append(1 + max((fronts[j] for j in range(i) if j * 7 % 5 <= i * 7 % 5), default=0))
    assert found == dict(enumerate(fronts))
    # a front has one row
    assert len(sizes) == 9 and all(n <= max(fronts[: 40 * (b + 1)]) for b, n in enumerate(sizes))


def test_ranges_of_a_sort_are_not_joined_again(spark):
    """ranges of few bytes, which hold many rows, came to one task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ranking.numbered(spark.range(3000).select("id", F.lit("x").alias("same")), [F.col("same"), F.col("id").desc()])
    assert len(placed.inputFiles()) == parts > 1
    assert placed.where(F.col("place") != 3000 - F.col("id")).count() == 0
