"""Operators on small cases: eligibility, views, fronts, candidates, graphs, CSV, streams."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.operators import eligibility, graphs, ranking
from tessera.sources import scratch, tables
from tessera.streaming import states


def test_intermediate_labels(spark):
    cases = {"Intermediate 3": True, "intermediates": True, "Intermediate": True, "Intermediately": False, "I-255": False, "interm. 4": True, "interm": False, " 中间体A": True, "an Intermediate": False, None: False, "INTERMEDIATE_2": True}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", eligibility.is_intermediate(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == cases


def test_source_exclusions(spark):
    cases = [("NA-1", None, [], None), ("n/a", None, [], "unconfirmed_identifier"), ("", None, [], "unconfirmed_identifier"), ("x" * 201, None, [], "unconfirmed_identifier"), ("a\nb", None, [], "unconfirmed_identifier"), ("编号待确认 3", None, [], "unconfirmed_identifier"), ("5", "source-structure:2", [], "unconfirmed_identifier"), ("5", "Intermediate 5", [], "intermediate"), ("I-5", None, ["structure_number_unconfirmed"], "unconfirmed_identifier"), ("I-5", None, None, None)]
    rows = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, l string, s string, i array<string>")
    found = rows.select("k", eligibility.source_exclusion(F.col("l"), F.col("s"), F.col("i")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in found] == [c[3] for c in cases]


def test_first_refusal_wins(spark):
    good = {"id": "1", "confidence": "high", "structure": "s", "image": "p", "page": 3, "flags": ["low"], "review": None, "stale": False, "recognition": "valid", "quality": "ok", "graph": True}
    changes = [({}, None), ({"confidence": "low", "stale": True}, "ownership_unproved"), ({"page": 20_001}, "ownership_unproved"), ({"page": None}, "ownership_unproved"), ({"flags": ["ambiguous_smiles"]}, "ownership_unproved"), ({"review": "needs_review", "stale": True}, "review"), ({"stale": True, "graph": False}, "stale_correction"), ({"recognition": "failed"}, "recognition"), ({"quality": "blurred"}, "recognition"), ({"graph": None}, "graph"), ({"flags": None, "review": "accepted"}, None)]
    schema = "id string, confidence string, structure string, image string, page int, flags array<string>, review string, stale boolean, recognition string, quality string, graph boolean, k int"
    rows = spark.createDataFrame([(*(good | c).values(), k) for k, (c, _) in enumerate(changes)], schema)
    found = rows.select("k", eligibility.lead_refusal({c: F.col(c) for c in good}).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in found] == [w for _, w in changes]


def test_scopes(spark):
    rows = spark.createDataFrame([(1, True, "selected"), (2, True, None), (3, False, "selected"), (4, False, None)], "molecule int, strong boolean, candidate_status string")
    fragments = spark.createDataFrame([("r", 1, "f", True, 1), ("r", 1, "f", True, 2), ("r", 1, "g", False, 3), ("r", 1, "g", False, 1), ("q", 2, "f", False, 4)], "region string, reference int, fragment string, is_reference boolean, molecule int")
    scaffolds = spark.createDataFrame([("s", 1), ("s", 3)], "scaffold string, molecule int")
    ids = lambda **k: sorted(r["molecule"] for r in eligibility.in_scope(rows, scaffolds=scaffolds, fragments=fragments, **k).collect())
    assert ids() == [1, 2, 3, 4] and ids(scope="strong") == [1, 2] and ids(scope="leads") == [1, 3]
    assert ids(scaffold="s", region="r") == [1, 3] and ids(scope="changes", region="r") == [3] and ids(scope="strong_changes", region="r") == []
    assert ids(reference=2) == [4] and ids(region="r", fragment="f") == [1, 2]
    for wrong in ({"fragment": "f"}, {"region": "q", "reference": 1}, {"scaffold": "t"}, {"scope": "some"}, {"region": "q", "fragment": "g"}):
        with pytest.raises(ValueError):
            ids(**wrong)


def test_places_are_one_to_n(spark):
    rows = spark.range(5000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"))
    found = ranking.numbered(rows, [F.col("k"), F.col("id").desc()])
    assert found.columns == ["id", "k", "place"]
    got = sorted((r["place"], r["k"], -r["id"]) for r in found.collect())
    assert [p for p, *_ in got] == list(range(1, 5001)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
    assert found.where("place <= 10").count() == 10  # the same when it is read again


def test_depths_against_chains(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), k, *(sorted((rng.randrange(6), rng.randrange(6))) if rng.random() < 0.5 else [rng.randrange(6)] * 2), *[rng.randrange(5)] * 2) for k in range(120)]
    found = {r["k"]: r["front"] for r in ranking.pareto_depths(spark.createDataFrame(rows, "g int, k int, a int, b int, c int, d int"), ["g"], "k", [("a", "b"), ("c", "d")]).collect()}

    def over(x, y):
        sides = [(x[i + 1] < y[i], x[i] == x[i + 1] == y[i] == y[i + 1]) for i in (2, 4)]
        return x[0] == y[0] and all(b or s for b, s in sides) and any(b for b, _ in sides)

    def depth(y):
        return 1 + max((depth(x) for x in rows if over(x, y)), default=0)

    assert found == {r[1]: depth(r) for r in rows}


def test_depths_of_a_group_in_many_blocks(spark, monkeypatch):
    """Blocks of seven vectors, three groups of very different sizes, one of them null: as one block each."""
    rng = random.Random(6)
    rows = [(rng.choice(["a"] * 18 + ["b", None]), k, *(float(rng.randrange(9)) for _ in range(2))) for k in range(160)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double")
    ranks = lambda: sorted(((r["g"], r["k"], r["front"]) for r in ranking.pareto_depths(df, ["g"], "k", [("x", "x"), ("y", "y")]).collect()), key=str)
    whole = ranks()
    monkeypatch.setattr(ranking, "BLOCK", 7)
    assert ranks() == whole and max(f for *_, f in whole) > 4
    assert ranking.pareto_depths(df.limit(0), ["g"], "k", [("x", "x"), ("y", "y")]).collect() == []


def test_places_of_exact_ends(spark):
    """An open end that touches proves an order, two closed ones don't, and the twentieth digit counts; unknown values prove nothing."""
    cases = {"a": "[1,2]", "b": "<1", "c": ">2", "d": "[2,3]", "e": "2.00000000000000000001", "f": "2", "g": "ND"}
    rows = N.parsed(spark.createDataFrame(list(cases.items()), "k string, raw string"), "raw", "v")
    lower = {r["k"]: (r["v_low"], r["v_high"]) for r in ranking.interval_places(rows, ["v"], ["lower"]).collect()}
    below = {(a, b) for a in cases for b in cases if lower[a][1] < lower[b][0]}
    assert below == {("b", x) for x in "acdef"} | {(x, "c") for x in "af"} | {("a", "e"), ("f", "e")}
    higher = {r["k"]: (r["v_low"], r["v_high"]) for r in ranking.interval_places(rows, ["v"], ["higher"]).collect()}
    assert {(b, a) for a in cases for b in cases if higher[b][1] < higher[a][0]} == {(b, a) for a, b in below}
    fronts = ranking.pareto_depths(ranking.interval_places(rows, ["v"], ["lower"]), [], "k", [("v_low", "v_high")])
    assert {r["k"]: r["front"] for r in fronts.collect()} == {"b": 1, "a": 2, "d": 2, "f": 2, "g": 1, "c": 3, "e": 3}


def test_candidates_against_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(k, k // 2, rng.choice([1, 1, 2, None]), -rng.randrange(2), [rng.random() for _ in range(4)] if rng.random() < 0.7 else None) for k in range(40)]
    found = [r["k"] for r in ranking.select_candidates(spark.createDataFrame(rows, "k int, m int, front int, cov int, v array<double>"), "k", "m", ["front", "cov"], "v", 9).orderBy("pick").collect()]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    left, picks = [r for r in rows if r[2] is not None], []
    while left and len(picks) < 9:
        best = min(r[2:4] for r in left)
        pool, known = [r for r in left if r[2:4] == best], [p[4] for p in picks if p[4]]
        if known and any(r[4] for r in pool):
            pool = sorted((r for r in pool if r[4]), key=lambda r: max(cosine(r[4], v) for v in known))
        picks.append(pool[0])
        left = [r for r in left if r[1] != pool[0][1]]
    assert found == [p[0] for p in picks]


def random_graph(rng, n):
    bonds = [(rng.randrange(k), k) for k in range(1, n)] + [tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 2))]
    return graphs.Graph([rng.choice("CCN") for _ in range(n)], [{"a": a, "b": b, "kind": rng.choice("12")} for a, b in dict.fromkeys(bonds)])


def test_regions_are_all_that_few_bonds_join():
    rng = random.Random(3)
    for _ in range(40):
        g = random_graph(rng, rng.randint(2, 7))
        want = {}
        for size in range(1, len(g.labels)):
            for side in map(frozenset, itertools.combinations(range(len(g.labels)), size)):
                cut = frozenset(k for k, (a, b, _) in enumerate(g.bonds) if (a in side) != (b in side))
                if 1 <= len(cut) <= 3 and g.reached(min(side), cut) == side:
                    want[side] = cut
        assert graphs.regions(g) == want


def chain_of(n, bonds):
    return graphs.Graph(["C"] * n, [{"a": a, "b": b, "kind": "-"} for a, b in bonds])


def test_regions_of_few_atoms_or_bonds_and_of_several_pieces():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randint(1, 10)
        bonds = {(rng.randrange(v), v) for v in range(1, n) if rng.random() < 0.9} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 4) if n > 1 else 0)}
        g = chain_of(n, sorted(bonds))
        for most in (1, 2, 3):
            want = {}
            for cut in itertools.chain.from_iterable(itertools.combinations(g.edges(), size) for size in range(1, most + 1)):
                for end in itertools.chain.from_iterable(g.edges()[k] for k in cut):
                    side = g.reached(end, frozenset(cut))
                    if all((g.edges()[k][0] in side) != (g.edges()[k][1] in side) for k in cut):
                        want[side] = frozenset(cut)
            assert graphs.regions(g, most) == want
            assert graphs.regions(g, most, 3) == {k: v for k, v in want.items() if len(k) <= 3}


def test_regions_of_large_graphs_in_bounded_time():
    shapes = {
        "chain": (512, [(k, k + 1) for k in range(511)], 15888),
        "ladder": (512, [(k, k + 2) for k in range(510)] + [(2 * k, 2 * k + 1) for k in range(256)], 608),
        "cycle": (512, [(k, (k + 1) % 512) for k in range(512)], 16384),
        "ring with leaves": (512, [(k, (k + 1) % 256) for k in range(256)] + [(k, k + 256) for k in range(256)], 39168),
    }
    for name, (n, bonds, count) in shapes.items():
        began = time.process_time()
        assert len(graphs.regions(chain_of(n, bonds), 3, 32)) == count, name
        assert time.process_time() - began < 3, name


def test_a_hydrogen_may_vary(spark):
    """C-C-O and C-C-O-N share the background that lacks the hydrogen of O, or N."""
    rows = spark.createDataFrame([("a", list("CCO"), [(0, 1, "-"), (1, 2, "-")], [3, 2, 1]), ("b", list("CCON"), [(0, 1, "-"), (1, 2, "-"), (2, 3, "-")], None)], "name string, atoms array<string>, bonds array<struct<a:int,b:int,kind:string>>, h array<int>")
    keys = graphs.cut_keys(rows, "name", "atoms", "bonds", least_fixed=3, hydrogens="h")
    found = [(r["name"], r["variable"], r["site"], r["key"]) for r in keys.collect()]
    sites = {site: key for name, _, site, key in found if name == "a" and site is not None}
    assert set(sites) == {0, 1, 2} and next(key for name, v, _, key in found if name == "b" and v == [3]) == sites[2]
    more, bonds = graphs.with_hydrogen(F.col("atoms"), F.col("bonds"), F.lit(2))
    pair = rows.where("name = 'a'").select(more.alias("ra"), bonds.alias("rb")).crossJoin(rows.where("name = 'b'").select("atoms", "bonds"))
    assert pair.select(graphs.verified((F.col("ra"), F.col("rb"), F.array(F.lit(3))), (F.col("atoms"), F.col("bonds"))).alias("x")).first()["x"] == "matched"


def test_embeddings_against_all_injections():
    rng = random.Random(4)
    seen = set()
    for _ in range(150):
        ref, cand = random_graph(rng, rng.randint(3, 5)), random_graph(rng, rng.randint(3, 6))
        side = rng.choice(list(graphs.regions(ref)) or [frozenset([0])])
        fixed = [k for k in range(len(ref.labels)) if k not in side]
        anchors = [k for k in fixed if any(o in side for o in ref.near[k])]
        found = set()
        for image in itertools.permutations(range(len(cand.labels)), len(fixed)):
            at = dict(zip(fixed, image))
            rest = set(range(len(cand.labels))) - set(image)
            fits = all(ref.labels[k] == cand.labels[at[k]] for k in fixed) and all(ref.near[k].get(o, (0, None))[1] == cand.near[at[k]].get(at[o], (0, None))[1] for k, o in itertools.combinations(fixed, 2))
            fits = fits and all(len(ref.near[k]) == len(cand.near[at[k]]) for k in fixed if k not in anchors)
            inner = frozenset(k for k, (a, b, _) in enumerate(cand.bonds) if (a in rest) != (b in rest))
            if fits and rest and cand.reached(min(rest), inner) == rest:
                found.add(tuple(at[k] for k in anchors))
        want = "not_matched" if not found else "matched" if len(found) == 1 else "ambiguous"
        seen.add(want)
        assert graphs.compared(ref, side, cand) == want
    assert len(seen) == 3
    assert graphs.compared(graphs.Graph(None, None), frozenset([0]), cand) == "ineligible"


def test_equal_backgrounds_have_equal_keys():
    rng = random.Random(5)
    for _ in range(30):
        g = random_graph(rng, 8)
        order = rng.sample(range(8), 8)
        turned = graphs.Graph([g.labels[order.index(k)] for k in range(8)], [{"a": order[a], "b": order[b], "kind": kind} for a, b, kind in g.bonds])
        for side in graphs.regions(g):
            assert graphs.background_key(g, side) == graphs.background_key(turned, frozenset(order[k] for k in side))


CSV = [
    ("id,smiles,IC50 (nM)\nü1,C,5\n2,,\n", "utf-16", [("ü1", "C", "5"), ("2", "", "")]),
    ("id;smiles;IC50 (nM)\n'1';\"C;C\";\"a \"\"b\"\"\"\n", "utf-8-sig", [("'1'", "C;C", 'a "b"')]),
    ('id\tsmiles\tIC50 (nM)\n 1 \t"x\ny"\t3\n', "utf-8", [(" 1 ", "x\ny", "3")]),
]


@pytest.mark.parametrize("text,encoding,want", CSV)
def test_csv(spark, tmp_path, text, encoding, want):
    (tmp_path / "x.csv").write_bytes(text.encode(encoding))
    rows = tables.csv(spark, str(tmp_path / "x.csv"))
    assert rows.columns == ["id", "smiles", "IC50 (nM)"] and [tuple(r) for r in rows.collect()] == want


@pytest.mark.parametrize("text", ["", "id,id\n1,2\n", "id,\n1,2\n", "only\n1\n"])
def test_csv_headers_are_refused(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(tables.SourceError):
        tables.csv(spark, str(tmp_path / "x.csv"))


@pytest.mark.parametrize("text", ["a,b\n1,2,3\n", "a,b\n1\n", "a,b\n1,x\x00y\n"])
def test_csv_rows_are_refused(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        tables.csv(spark, str(tmp_path / "x.csv")).collect()


def test_multi_line_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"a\nb",c\n1,2\n')
    assert tables.csv(spark, str(tmp_path / "x.csv")).columns == ["a\nb", "c"]


def test_fingerprints_ignore_order_and_count_repeats(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, None)]
    of = lambda r: {x["k"]: (x["n"], x["fingerprint"]) for x in tables.fingerprint(spark.createDataFrame(r, "k int, v string"), ["k"], ["v"]).collect()}
    assert of(rows) == of(rows[::-1]) and of(rows)[1][0] == 3
    assert of(rows)[1] != of(rows[1:])[1] and of(rows)[1][1] != of([rows[0], rows[1]])[1][1]


def test_snapshot(spark):
    docs = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 3, "c")], "project string, id int, v string")
    edits = spark.createDataFrame([(2, 1, "B")], "id int, revision int, v string")
    reviews = spark.createDataFrame([(1, "rejected")], "id int, decision string")
    rows, made = tables.snapshot(docs, "project", "id", docs.limit(0), edits, reviews, ["v"], "r1")
    assert sorted(tuple(r) for r in rows.collect()) == [("p", 2, "B"), ("q", 3, "c")]
    other = tables.snapshot(docs, "project", "id", docs.limit(0), edits.limit(0), reviews, ["v"], "r1")[1]
    a, b = ({r["project"]: r["revision"] for r in x.collect()} for x in (made, other))
    assert a["p"] != b["p"] and a["q"] == b["q"]
    with pytest.raises(Exception, match="running"):
        tables.snapshot(docs, "project", "id", docs.where("project = 'p'"), edits, reviews, ["v"], "r1")[0].collect()


def streamed(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def drained(spark, stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state-{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_arriving_requests(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    schema = "id string, h string, at timestamp"
    stream = streamed(spark, tmp_path, [[("a", "x", at(0)), ("a", "x", at(1)), ("b", "y", at(1))], [("a", "z", at(2)), ("b", "y", at(3)), ("c", "w", at(3))]], schema)
    found = sorted((r["id"], r["h"], r["at"].minute, r["verdict"]) for r in drained(spark, states.arriving_requests(stream, "id", "h", "at", "10 minutes"), tmp_path, "judged"))
    assert found == [("a", "x", 0, "new"), ("a", "x", 1, "same"), ("a", "z", 2, "conflict"), ("b", "y", 1, "new"), ("b", "y", 3, "same"), ("c", "w", 3, "new")]
    first = drained(spark, states.first_requests(stream, "id", "at", "10 minutes"), tmp_path, "first")
    assert sorted(r["id"] for r in first) == ["a", "b", "c"]


def test_scratch_tables_go(spark):
    with scratch.scratch_tables(spark):
        inner = scratch.cut(spark.range(3), "inner")
        kept = scratch.cut(spark.range(4), "kept", keep=True)
        assert inner.count() == 3
    assert kept.count() == 4
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(getattr(inner, scratch.PATH)).count()
    scratch.release(kept)


def test_readings_stay_by_strings(spark):
    """A filter on what a string says is not moved down to the rows, where each would be read again."""
    rows = N.parsed(spark.createDataFrame([("5",), ("ND",), ("<3",), (None,)], "raw string"), "raw").where("v.kind <> 'missing'")
    assert sorted(r["raw"] for r in rows.collect()) == ["5", "<3"]
    assert "RLIKE" not in rows._jdf.queryExecution().optimizedPlan().toString()
