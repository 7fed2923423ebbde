"""Exact values: parsing, order, units, and comparisons against a quarter-point grid."""

import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import identifiers, numbers, text
from tessera.operators import filters, joins, merging, pages, ranking, statistics


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_bounds_sort_like_decimals(spark):
    values = ["0", "-0.0", "1e308", "-1e308", "12.50", "12.5", "-12.5", "-12.51", "-12.49", ".5", "1e-30", "00012", "123456789012345678901234567890.1", "123456789012345678901234567890.2", "-3e2", "-299.9"]
    rows = column(spark, values).select("x", numbers.bound(F.col("x")).alias("b")).collect()
    keys = {r["x"]: tuple(r["b"]) for r in rows}
    for a, b in itertools.combinations(values, 2):
        assert (keys[a] < keys[b]) == (Decimal(a) < Decimal(b)) and (keys[a] == keys[b]) == (Decimal(a) == Decimal(b)), (a, b)


def test_refused_numbers(spark):
    rows = column(spark, ["1e309", "abc", "", "1.2.3", "5e99999999999"]).select(numbers.bound(F.col("x")).alias("b")).collect()
    assert [r["b"] for r in rows] == [None] * 5


def test_kinds(spark):
    cases = {"10": "scalar", ">10": "interval", "≤3": "interval", "[2,10]": "interval", "(2, 10]": "interval", "1-3": "interval", "1..3": "interval", "[3,1]": "unsupported", "(2,2]": "unsupported", "NT": "missing", "—": "missing", None: "missing", "A": "ordinal", "G": "unsupported", "abc": "unsupported"}
    rows = column(spark, list(cases)).select("x", numbers.parse(F.col("x"), ["A"])["kind"].alias("k")).collect()
    assert {r["x"]: r["k"] for r in rows} == cases


def interval_points(low, high, lower, upper):
    return [q for q in range(4 * low, 4 * high + 1) if (lower or q > 4 * low) and (upper or q < 4 * high)]


def test_comparisons_against_a_grid(spark):
    """An order holds exactly if it holds for all pairs of quarter points that the intervals allow."""
    shapes = [(a, b, c, d) for a in range(3) for b in range(a, 3) for c in (True, False) for d in (True, False) if a < b or (c and d)]
    write = lambda s: f"{'[' if s[2] else '('}{s[0]},{s[1]}{']' if s[3] else ')'}"
    pairs = [(write(a), write(b)) for a in shapes for b in shapes]
    df = spark.createDataFrame(pairs, "a string, b string")
    found = df.select("a", "b", numbers.compare(numbers.parse(F.col("a")), numbers.parse(F.col("b")), "lower").alias("o")).collect()
    by_name = {write(s): interval_points(*s) for s in shapes}
    for r in found:
        reference, candidate = by_name[r["a"]], by_name[r["b"]]
        want = "better" if max(candidate) < min(reference) else "worse" if max(reference) < min(candidate) else None
        if want:
            assert r["o"] == want, (r["a"], r["b"])
        elif set(reference) & set(candidate):
            assert r["o"] == "indeterminate", (r["a"], r["b"])


def test_units(spark):
    rows = column(spark, ["5 uM", "5 nM", "5", "5 %", "<2 µM"]).select(numbers.inline(F.col("x"), F.lit("nM")).alias("v")).select("v.kind", numbers.approximate(F.col("v.high")).alias("h")).collect()
    assert [(r["kind"], r["h"]) for r in rows] == [("scalar", 5000.0), ("scalar", 5.0), ("scalar", 5.0), ("unsupported", None), ("interval", 2000.0)]


def test_natural_order(spark):
    values = ["10", "C10", "8B", "2", "8", "C9", "8A", "99999999999999999999999999999999999999999"]
    rows = column(spark, values).orderBy(identifiers.natural_key(F.col("x"))).collect()
    assert [r["x"] for r in rows] == ["2", "8", "8A", "8B", "10", "99999999999999999999999999999999999999999", "C9", "C10"]


@pytest.mark.parametrize(("raw", "count", "want"), [("10", 9, "insufficient"), ("10", 10, "ready")])
def test_tenth_decade_population(spark, raw, count, want):
    df = spark.createDataFrame([("c", f"s{k}", raw) for k in range(count)], "c string, s string, raw string")
    assert statistics.tenth_decade(df, ["c"], "s", "raw").first()["status"] == want


@pytest.mark.parametrize(("last", "want"), [("[1,9]", "ready"), ("[1,10]", "ambiguous"), ("[1,10)", "ready"), (">1", "ambiguous"), ("nonsense", "ambiguous")])
def test_tenth_decade_ends(spark, last, want):
    df = spark.createDataFrame([("c", f"s{k}", "1") for k in range(9)] + [("c", "last", last)], "c string, s string, raw string")
    assert statistics.tenth_decade(df, ["c"], "s", "raw").first()["status"] == want


def test_filters_are_checked():
    for bad in (filters.Filter("nope", "in", values=("a",)), filters.Filter("cell", "gt", "NaN"), filters.Filter("cell", "gt", ">5"), filters.Filter("cell", "band", "strong"), filters.Filter("cell", "contains", " ")):
        with pytest.raises(filters.FilterError):
            filters.checked([bad], {"cell": "text"})


def test_reconciliation(spark):
    observed = spark.createDataFrame([("d", "Cpd-15", 2), ("d", "Cpd-7", 1), ("d", "Cpd-8B", 1)], "doc string, cpd string, n long")
    known = spark.createDataFrame([("d", "Cpd-15"), ("d", "Cpd-115"), ("d", "Cpd-7"), ("d", "Cpd-88")], "doc string, cpd string")
    found = {(r["original"], r["suggested"], r["kind"]) for r in joins.reconciled(observed, known, "doc").collect()}
    assert found == {("Cpd-8B", "Cpd-88", "extra"), ("Cpd-15", "Cpd-115", "missing")}


def test_row_merge(spark):
    df = spark.createDataFrame([("d", "c", 1, 1, {"a": "1"}), ("d", "c", 1, 2, {"a": "2"}), ("d", "c", 2, 3, {"b": "3"}), ("d", "c", None, 4, {"b": "4"})], "d string, c string, p int, o long, v map<string,string>")
    rows = merging.merged_rows(df, "d", "c", "p", "o", "v").collect()
    assert sorted((r["o"], sorted((x["key"], x["value"]) for x in r["v"])) for r in rows) == [(1, [("a", "1"), ("b", "3")]), (2, [("a", "2"), ("b", "4")])]


def test_page_runs(spark):
    table, weak, text_ = "Compound No. Structure 1 2 3 4 5 6", "1 x 301.1\n2 y 302.2", "plain words"
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate([text_, table, "", weak, weak, text_, weak])], "s string, p int, t string")
    rows = pages.extended(pages.classified(df, "t"), "s", "p").orderBy("p").collect()
    assert [r["synthesis"] for r in rows] == [False, True, False, True, True, False, False]


def test_pareto_depths(spark):
    df = spark.createDataFrame([("g", 1, 1.0, 1.0, 5.0, 5.0), ("g", 2, 2.0, 2.0, 6.0, 6.0), ("g", 3, 1.0, 3.0, 7.0, 7.0), ("g", 4, 1.0, 1.0, 5.0, 5.0)], "g string, i int, a double, b double, c double, d double")
    assert {r["i"]: r["front"] for r in ranking.pareto_depths(df, "g", "i", [("a", "b"), ("c", "d")]).collect()} == {1: 1, 2: 2, 3: 1, 4: 1}


def test_text(spark):
    rows = column(spark, ["=1", " +2", "\tx", "fine", "-"]).select(text.formula_safe(F.col("x")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["'=1", "' +2", "'\tx", "fine", "'-"]


def test_declared_units(spark):
    cases = {("5 mg/kg", "mg/kg"): ("scalar", 5.0), ("5", "mg/kg"): ("scalar", 5.0), ("<5mg/kg", "mg/kg"): ("interval", 5.0), ("5 mg", "mg/kg"): ("unsupported", None), ("3 10^6 cells", "10^6 cells"): ("scalar", 3.0), ("310^6 cells", "10^6 cells"): ("unsupported", None), ("mg/kg", "mg/kg"): ("unsupported", None), ("5 unknown", "unknown"): ("unsupported", None), ("1e1", "e1"): ("scalar", 10.0), ("NT h", "h"): ("unsupported", None)}
    rows = spark.createDataFrame(list(cases), "a string, u string").select("a", "u", numbers.declared(F.col("a"), F.col("u")).alias("v")).select("a", "u", "v.kind", numbers.approximate(F.col("v.high")).alias("h")).collect()
    assert {(r["a"], r["u"]): (r["kind"], r["h"]) for r in rows} == cases


def test_exact_differences_and_folds(spark):
    pairs = [("0.1", "0.3"), ("1e30", "1000000000000000000000000000001"), ("5", ">3"), ("1e-308", "1e308"), ("0", "4"), ("2", "-4"), ("10", "2")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", numbers.parse(F.col("a")).alias("x"), numbers.parse(F.col("b")).alias("y"))
    found = {(r["a"], r["b"]): (r["d"], r["f"]) for r in rows.select("a", "b", numbers.difference(F.col("x"), F.col("y")).alias("d"), numbers.fold(F.col("x"), F.col("y"), "lower").alias("f")).collect()}
    assert found == {("0.1", "0.3"): (0.2, float(Decimal(1) / 3)), ("1e30", "1000000000000000000000000000001"): (1.0, 1.0), ("5", ">3"): (None, None), ("1e-308", "1e308"): (1e308, None), ("0", "4"): (4.0, None), ("2", "-4"): (-6.0, None), ("10", "2"): (-8.0, 5.0)}


def test_value_tokens(spark):
    cases = {"12 >5 A": ["12", ">5", "A"], "12nM, 3": None, "12 nM ;3": ["12 nM", "3"], "about 5": None, "": [], "1,5 2.5±0.3%": ["1,5", "2.5±0.3%"], "2.5±0.3 N/A not tested": ["2.5±0.3", "N/A", "not tested"], "[1, 2] +++": ["[1, 2]", "+++"], "5x": None, "1e9999": None, "－": None, "— –": ["—", "–"]}
    rows = column(spark, list(cases)).select("x", text.value_tokens(F.col("x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in rows} == cases


def test_plain_numbers_take_the_compiled_steps(spark):
    """every string went through the whole reader, an interpreted one. Both say the same, and what plain ones say is never read by it."""
    cases = ["12", " 1.50 ", "+.5", "-0.00", "-12.30e-5", "007", "1e308", "1e309", "1e99999999999", "9" * 256, "9" * 257, "1.", "<5", "[1,2]", "1-2", "ND", "", "x", None, "1e5e5", "."]
    rows = column(spark, cases)
    whole = rows.select("x", numbers.parse(F.col("x")).alias("v"))
    assert {r["x"]: r["v"] for r in numbers.parsed(rows, "x").collect()} == {r["x"]: r["v"] for r in whole.collect()}
    plain = column(spark, cases[:10]).select(F.col("x").alias("__raw"))
    refused = F.raise_error(F.lit("read whole")).cast(whole.schema["v"].dataType)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(numbers, "reading", lambda read: refused)
        assert numbers.read_strings(plain, "v").where("v.kind in ('scalar', 'unsupported')").count() == 10
