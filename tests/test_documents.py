"""Headers, turned tables, text tables, legends, located pages and shared parts on small cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import headers, sections, structures
from tessera.operators import joins, pages, text_tables, transposed
from tessera.sources import scratch, shared

HEADERS = {
    "IC50 (nM)": ("IC50 (nM)", "IC50 (nM)"),
    "I C 5 O (n M)": ("IC50 (nM)", "IC50 (nM)"),
    "p IC50": ("pIC50", "pIC50 (unit unknown)"),
    "IC50nM": ("IC50 nM", "IC50 (nM)"),
    "hERG IC50 uM": ("hERG IC50 uM", "hERG IC50 (uM)"),
    "K i (µM)": ("Ki (µM)", "Ki (µM)"),
    "DC₅₀（nM）": ("DC50(nM)", "DC50 (nM)"),
    "CancerIC50 (nM)": ("Cancer IC50 (nM)", "Cancer IC50 (nM)"),
    "Dmax %": ("Dmax %", "Dmax (%)"),
    "EC50 Ki": ("EC50 Ki", "Unknown activity field 3: EC50 Ki (unit unknown)"),
    "Target (x)": ("Target (x)", "Unknown activity field 3: Target (x)"),
    "t1/2 (h)": ("t1/2 (h)", "t1/2 (h)"),
    "Ratio": ("Ratio", "Ratio"),
    "CL (mL/min/kg)": ("CL (mL/min/kg)", "CL (mL/min/kg)"),
    "AUC0-t": ("AUC0-t", "AUC0-t (unit unknown)"),
    "Tumor volume (mm3)": ("Tumor volume (mm3)", "Tumor volume (mm3)"),
    "IC50 (24 h) (nM)": ("IC50 (24 h) (nM)", "IC50 (24 h) (nM)"),
    "": ("", "Unknown activity field 3 (unit unknown)"),
    "y" * 300: ("y" * 300, "Unknown activity field 3 (unit unknown)"),
    None: ("", "Unknown activity field 3 (unit unknown)"),
}


def test_headers(spark):
    rows = spark.createDataFrame([(k,) for k in HEADERS], "c string").select("c", headers.metric_text(F.col("c")).alias("t"), headers.field_name(F.col("c"), F.lit(3)).alias("f"))
    assert {r["c"]: (r["t"], r["f"]) for r in rows.collect()} == HEADERS
    names = ["A (nM)", "A (nM)", "B", "compound_id", "A [column 1] (nM)"]
    found = spark.range(1).select(headers.distinct_fields(F.array(*[F.lit(n) for n in names])).alias("x")).first()["x"]
    assert found == ["A [column 1; 2] (nM)", "A [column 2] (nM)", "B", "compound_id [column 4]", "A [column 1] (nM)"]


def cells_of(spark, matrices):
    rows = [(t, r, c, text) for t, matrix in matrices.items() for r, row in enumerate(matrix) for c, text in enumerate(row)]
    return spark.createDataFrame(rows, "t string, row int, col int, text string")


def test_transposed(spark):
    over, body = ["", "Caspase activity", None, "Cytokine release", None], [["IC50 (nM)", "2", "300", "4", "600"], ["Imax (%)", "80", "90", "70", "95"]]
    matrices = {
        "paired": [over, ["", "Compound 17", "Ref. 1", "Compound 17", "Ref. 1"], *body],
        "doses": [over, ["", "10", "100", "10", "100"], *body],
        "named": [over, ["", "Compound 17", "comparison-X", "Compound 17", "comparison-X"], *body],
        "remark": [["", "Compound 1"], ["IC50 (nM)", "5"], ["Remarks", "6"]],
        "two metrics in one": [["", "Compound 1"], ["IC50 Ki", "5"]],
        "late": [["a", "b"], ["c", "d"], ["e", "f"], ["", "Compound 1"], ["Ki (nM)", "5"]],
        "twice": [["", "Cpd 1"], ["Ki (nM)", "5"], ["Ki (nM)", ""], ["n", "two"]],
        "empty": [["", "Compound 1"]],
    }
    cells = cells_of(spark, matrices)
    found = {}
    for r in sorted(transposed.transposed_rows(cells, ["t"]).collect(), key=lambda r: (r["t"], r["col"], r["row"])):
        found.setdefault(r["t"], []).append((r["cpd"], r["field"], r["value"], r["count"], r["needs_review"]))
    assert set(found) == {"paired", "named", "twice"}
    assert [x[:3] for x in found["named"]] == [("Compound 17", "Caspase activity IC50 (nM)", "2"), ("Compound 17", "Caspase activity Imax (%)", "80"), ("Compound 17", "Cytokine release IC50 (nM)", "4"), ("Compound 17", "Cytokine release Imax (%)", "70")]
    assert len(found["paired"]) == 8 and {x[0] for x in found["paired"]} == {"Compound 17", "Ref. 1"} and not any(x[4] for x in found["paired"])
    assert found["twice"] == [("Compound 1", "Ki [column 1] (nM)", "5", None, False), ("Compound 1", "Ki [column 2] (nM)", "", None, True), ("Compound 1", "Unknown activity field 3: n (unit unknown)", "two", "reported_n", False)]
    assert sorted((r["t"], r["col"], r["text"]) for r in transposed.unsupported_columns(cells, ["t"]).collect()) == [("named", 2, "comparison-X"), ("named", 4, "comparison-X")]
    assert transposed.transposed_rows(cells.limit(0), ["t"]).collect() == []


PAGES = {
    "two tables": ("Target x\nCompound No. | IC50 (nM)\n1 | 5\n2 | 6\nNote: end\nprose\n9 | 9\nCpd ID | Ki (uM) | n\n3 | 7 | 3\n4 | <8\nCompound ID | EC50 (nM)\n9 | A", [(1, 2, "Compound 1", {"IC50 (nM)": "5"}, False), (1, 3, "Compound 2", {"IC50 (nM)": "6"}, False), (2, 8, "Compound 3", {"Ki (uM)": "7"}, False), (2, 9, "Compound 4", {"Ki (uM)": "<8"}, False), (3, 11, "Compound 9", {"EC50 (nM)": "A"}, False)]),
    "header of several lines": ("Compound\nCompound No.\nIC50 (nM)\nKi (nM)\n5 1.5 ND\nCpd 6 2 3", [(1, 4, "Compound 5", {"IC50 (nM)": "1.5", "Ki (nM)": "ND"}, False), (1, 5, "Compound 6", {"IC50 (nM)": "2", "Ki (nM)": "3"}, False)]),
    "flattened": ("Compound No. IC50 (nM) Compound 5 1.5 Compound 6 ND Compound 7 about 3", [(1, 0, "Compound 5", {"IC50 (nM)": "1.5"}, False), (1, 0, "Compound 6", {"IC50 (nM)": "ND"}, False)]),
    "series": ("Cpd ID IC50 (nM) AB-1 A AB-2 B\n* stop\nAB-3 C", [(1, 0, "Compound AB-1", {"IC50 (nM)": "A"}, False), (1, 0, "Compound AB-2", {"IC50 (nM)": "B"}, False)]),
    "too few": ("Cpd ID IC50 (nM) Ki (nM)\n5 7", [(1, 1, "Compound 5", {"IC50 (nM)": "", "Ki (nM)": ""}, True)]),
    "beyond the header": ("Cpd ID | Ki (nM)\n5 | 7 | 8", [(1, 1, "Compound 5", {"Ki (nM)": "7", "Unknown activity field 2 (unit unknown)": "8"}, True)]),
    "no metric": ("Compound No. | Name\n5 | 7", []),
    "prose": ("Compound No. IC50 (nM)\n12 mice were given 5 mg", []),
    "blank": ("", []),
    "none": (None, []),
}


def test_text_tables(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "doc string, t string")
    found = {k: [] for k in PAGES}
    for r in sorted(text_tables.table_rows(rows, ["doc"], "t").collect(), key=lambda r: (r["line"], r["part"])):
        found[r["doc"]].append((r["segment"], r["line"], r["cpd"], r["values"], r["needs_review"]))
    assert found == {k: v[1] for k, v in PAGES.items()}


def test_many_columns(spark):
    page = "No. | " + " | ".join(f"m{k} IC50 (nM)" for k in range(400)) + "\n1 | " + " | ".join(str(k) for k in range(400))
    (row,) = text_tables.table_rows(spark.createDataFrame([(1, page)], "doc int, t string"), ["doc"], "t").collect()
    assert row["values"] == {f"m{k} IC50 (nM)": str(k) for k in range(400)} and not row["needs_review"]


def test_legends(spark):
    said = {
        "agree": [(1, "Letter codes for IC50 include: A (<10 nM), B (10-100 nM)"), (2, "letter  codes for IC50 (nM)\ninclude: B (10-100 nM), C (>100 nM). Table 3. Other: A (none)")],
        "conflict": [(1, "letter codes for IC50 include: A (1 nM), B (2 nM)"), (2, "letter codes for IC50 include: A (3 nM), B (2 nM)")],
        "endpoints": [(1, "letter codes for IC50 include: A (1), B (2). letter codes for Ki include: C (1), D (2)")],
        "units": [(1, "letter codes for IC50 include: A (1 nM), B (2 uM)")],
        "one grade": [(1, "letter codes for IC50 include: A (1 nM)")],
        "no metric": [(1, "letter codes for colour include: A (1 nM), B (2 nM)")],
        "other form": [(1, "letter codes for IC50 are: A (1 nM), B (2 nM)")],
        "silent": [(1, "nothing"), (2, None)],
    }
    rows = spark.createDataFrame([(d, n, t) for d, v in said.items() for n, t in v], "doc string, page int, t string")
    legends = text_tables.grade_legends(rows, ["doc"], "page", "t")
    found = {r["doc"]: r for r in legends.collect()}
    assert {k: r["issues"] for k, r in found.items()} == {"agree": [], "conflict": ["conflicting_definitions"], "endpoints": ["conflicting_endpoints"], "units": ["conflicting_units"], "one grade": ["unsupported_declaration"], "no metric": ["unsupported_declaration"], "other form": ["unsupported_declaration"]}
    assert (found["agree"]["metric"], found["agree"]["grades"]) == ("ic50", {"A": "<10 nM", "B": "10-100 nM", "C": ">100 nM"})
    tables = [(d, f"Cpd ID | {h}\n1 | A") for d in ("agree", "conflict", "silent") for h in ("IC50 (nM)", "Ki (nM)", "IC50 (uM)", "IC50 (nM) and Ki (nM)")]
    joined = text_tables.table_rows(spark.createDataFrame([(d, k, t) for k, (d, t) in enumerate(tables)], "doc string, k int, t string"), ["doc", "k"], "t", legends).collect()
    assert {r["k"]: (r["legend"] is not None, r["needs_review"]) for r in joined} == {0: (True, False), 1: (False, True), 2: (False, True), 3: (False, True), **{k: (False, True) for k in range(4, 8)}, 8: (False, False), 9: (False, False), 10: (False, False), 11: (False, True)}


def test_structure_signals(spark):
    cases = {
        "Table 1. Compound No. Structure\nI-1 I-2": "table",
        "Table 2 Exemplary compounds\n" + "\n".join(f"Compound {k}" for k in range(7)): "table",
        "Table 2 Exemplary compounds\n" + "\n".join(f"Compound {k} IC50" for k in range(7)): None,
        "Example 12 was stirred": "caption",
        "Example 12 was praised": None,
        "Compound 3 OH and NH": "caption",
        "SUMMARY Example 12 was stirred": None,
        "1 234.5 phenyl\n2 345.6 pyridine\n3 456.7": "table",
        "the structure of Formula I": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    found = rows.withColumns(structures.structure_signals(F.col("t"))).collect()
    assert {r["t"]: r["seed"] for r in found} == cases


def spread(chain):
    """Evidence of {page: (seed, table_like, chemical, barrier, synthesis)}, page by page from a stack."""
    kinds = {"table": "numbered_structure_table", "caption": "numbered_synthesis_or_caption"}
    found = {p: kinds[v[0]] for p, v in chain.items() if v[0]}
    stack = list(found)
    while stack:
        at = stack.pop()
        for other in (at - 1, at + 1):
            if other in found or other not in chain or chain[other][3]:
                continue
            _, table_like, chemical, _, synthesis = chain[other]
            if found[at] in ("numbered_structure_table", "structure_table_continuation") and table_like:
                found[other] = "structure_table_continuation"
            elif found[at] in ("numbered_synthesis_or_caption", "synthesis_continuation") and chemical and synthesis:
                found[other] = "synthesis_continuation"
            else:
                continue
            stack.append(other)
    return found


def test_located_like_a_walk(spark):
    rng = random.Random(3)
    rows, want = [], []
    for doc in range(300):
        chain = {p: (rng.choice(["table", "caption"]) if rng.random() < 0.2 else None, rng.random() < 0.7, rng.random() < 0.7, rng.random() < 0.1, rng.random() < 0.9) for p in range(1, 25) if rng.random() < 0.95}
        rows += [(doc, p, *v) for p, v in chain.items()]
        want += [(doc, p, e) for p, e in spread(chain).items()]
    df = spark.createDataFrame(rows, "doc int, page int, seed string, table_like boolean, chemical boolean, barrier boolean, syn boolean")
    assert sorted(map(tuple, pages.located(df, "doc", "page", "syn").collect())) == sorted(want)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ref(key):
    return '{"$shared":"%s"}' % key


def test_shared_graphs(spark):
    a = '{"x":[1,1.0,-0.0]}'
    b, whole = (f'["q{{","\\"{{",{x},{x}]' for x in (ref(sha(a)), a))
    literal = '{"$literal":{"$shared":"zz"}}'
    deep = "[" * 200 + "]" * 200
    catalogue = [("good", sha(a), a), ("good", sha(whole), b), ("missing", sha(a), f"[{ref('nope')}]"), ("ring", "k1", f"[{ref('k2')}]"), ("ring", "k2", f"[{ref('k1')}]"), ("self", "k1", f"[{ref('k1')}]"), ("alias", sha(a), a), ("alias", "al", ref(sha(a))), ("unused", sha(a), a), ("other", "0" * 64, a), ("deep", sha(deep), deep), ("readonly", sha(a), a), (None, None, None)]
    # ten levels of ten references each: refused by its size, before a text of it is made
    key, text = sha(a), a
    catalogue.append(("bomb", key, text))
    for k in range(9):
        text = "[" + ",".join([ref(key)] * 10) + "]"
        key = f"level{k}"
        catalogue.append(("bomb", key, text))
    payloads = [("good", f'{{"p":{ref(sha(whole))},"l":{literal},"q":{ref(sha(a))}}}'), ("missing", f"[{ref(sha(a))}]"), ("ring", f"[{ref('k1')}]"), ("self", f"[{ref('k1')}]"), ("alias", f"[{ref('al')}]"), ("unused", "[1]"), ("other", f"[{ref('0' * 64)}]"), ("deep", "[" * 60 + ref(sha(deep)) + "]" * 60), ("bomb", f"[{ref(key)}]"), ("readonly", '[{"$shared":"%s","$readonly":true}]' % sha(a)), ("plain", '{"a":1}'), ("null", None)]
    found = shared.decoded(spark.createDataFrame(catalogue, "graph string, key string, value string"), spark.createDataFrame(payloads, "graph string, value string"))
    assert {r["graph"]: (r["value"], r["refusal"]) for r in found.collect()} == {
        "good": (f'{{"p":{whole},"l":{{"$shared":"zz"}},"q":{a}}}', None),
        "missing": (None, "missing_reference"),
        "ring": (None, "cycle"),
        "self": (None, "cycle"),
        "alias": (None, "alias_only"),
        "unused": (None, "unreachable"),
        "other": (None, "identity"),
        "deep": (None, "depth"),
        "bomb": (None, "size"),
        "readonly": (f"[{a}]", None),
        "plain": ('{"a":1}', None),
        "null": (None, None),
    }


@pytest.mark.parametrize("text, most", [("[]", 1), ('{"a":[1,{"b":"]]"}]}', 3), ('"x"', 0), ('["\\\\",["\\"["]]', 2)])
def test_nesting(spark, text, most):
    assert spark.createDataFrame([(text,)], "t string").select(shared.nesting(F.col("t"))["most"].alias("m")).first()["m"] == most


HEADINGS = {
    "Compound 17B: Preparation": (["17B"], "compound", "compound_heading", True),
    "[0012] Synthesis of Compound 5": (["5"], "compound", "compound_heading", True),
    "Compounds 1, 2 and 3A: Synthesis": (["1", "2", "3A"], "compound", "compound_heading", True),
    "Examples 1 & 2": (["1", "2"], "example", "compound_heading", False),
    "化合物1和2": (["1", "2"], "化合物", "compound_heading", False),
    "Compound １２Ａ: Synthesis": (["12A"], "compound", "compound_heading", True),
    "Example 12: HTRF assay": (["12"], "example", "assay_section", True),
    "Example 12: Synthesis of a probe for the HTRF assay": (["12"], "example", "ambiguous_heading", True),
    "Intermediate 4": (["4"], "intermediate", "intermediate_section", False),
    "中间体 3": (["3"], "中间体", "intermediate_section", False),
    "Example 3: Preparation of Intermediate 7": (["3"], "example", "intermediate_section", True),
    "Intermediate Compound 5: x": (["5"], "compound", "intermediate_section", False),
    "Compounds " + ", ".join(map(str, range(1, 33))): ([str(k) for k in range(1, 33)], "compound", "compound_heading", False),
    "Compounds " + ", ".join(map(str, range(1, 34))): ([], "compound", "too_many_members", False),
    "Compound 5 was stirred": None,
    "Compounds 1 to 5": None,
    "Compound 5 and 6": None,
    "Compound 12³: Synthesis": None,
    "The compound": None,
    "Compound 5 " + "x" * 5000: None,
    "": None,
    None: None,
}


def test_section_headings(spark):
    rows = spark.createDataFrame([(k,) for k in HEADINGS], "t string").select("t", sections.section_heading(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] and (r["h"]["members"], r["h"]["kind"], r["h"]["role"], r["h"]["boundary"]) for r in rows} == HEADINGS
    lines = spark.createDataFrame([("d", 1, "Compounds 8 and 9"), ("d", 2, "prose")], "doc string, line int, t string")
    assert [(r["line"], r["place"], r["identifier"]) for r in sections.heading_members(lines, ["doc"], "line", "t").collect()] == [(1, 0, "8"), (1, 1, "9")]


def test_carry_and_numbers_of_a_hot_key(spark):
    """One key with nearly all rows, in several parts, as one window gives it; null keys and values too."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.95 else rng.choice(["a", "b", None]), k, f"v{k}" if rng.random() < 0.01 else None) for k in range(4000)]
    df = spark.createDataFrame(rows, "k string, at int, v string").repartition(6)
    try:
        got = joins.numbered_in_parts(joins.carried_in_parts(df, ["k"], ["at"], F.col("v"), "owner"), ["k"], ["at"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    last, count, want = {}, {}, set()
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        last[k], count[k] = v or last.get(k), count.get(k, 0) + 1
        want.add((k, at, v, last[k], count[k]))
    assert len(got) == len(rows) and {(r["k"], r["at"], r["v"], r["owner"], r["number"]) for r in got} == want


def test_signs_of_metrics(spark):
    """The quick look at a line loses no metric that its repaired text names."""
    names = ["IC50 (nM)", "p I C 5O", "DC₅₀uM", "G_I 5 0", "K_i", "k D", "I m a x", "Y min", "C l i n t", "CL", "t1/2", "AUC0-inf", "TGI", "Dose", "Tumour  volume", "p value", "Ratio", "Grade", "F", "(F)", "FIC50", "Kit", "Of", "5 | 7", "", None, "* stop", "n M", "E\tC 50 nM"]
    lines = spark.createDataFrame([(x,) for x in names], "t string")
    text = headers.metric_text(F.col("t"))
    quick = headers.metric_signs(F.col("t"))
    for r in lines.select("t", text.rlike(headers.METRIC).alias("a"), text.rlike(rf"{headers.METRIC[:4]}^{headers.METRIC[4:]}$").alias("b"), quick.alias("q")).collect():
        assert (r["a"], r["b"]) == tuple(r["q"]), r


def test_pages_are_dealt(spark):
    """A table of one partition is read by as many tasks as a shuffle has, however small it is."""
    pages = spark.createDataFrame([(k, f"No. | IC50 (nM)\n{k} | 5") for k in range(40)], "k int, t string").coalesce(1)
    assert text_tables.segments(pages, ["k"], "t").rdd.getNumPartitions() == 4
    rows = text_tables.table_rows(pages, ["k"], "t")
    assert sorted((r["k"], r["values"]["IC50 (nM)"]) for r in rows.collect()) == [(k, "5") for k in range(40)]
    assert rows.rdd.getNumPartitions() == 4


def test_a_row_without_heading_spoils(spark):
    cells = spark.createDataFrame([("t", 0, 0, ""), ("t", 0, 1, "Compound 1"), ("t", 1, 0, "Ki (nM)"), ("t", 1, 1, "5"), ("t", 2, 1, "6")], "t string, row int, col int, text string")
    assert transposed.transposed_rows(cells, ["t"]).collect() == []
    assert len(transposed.transposed_rows(cells.where("row < 2"), ["t"]).collect()) == 1


ODD_TABLES = [
    *[("sound", r, c, x) for r, row in enumerate([["", "Assay", None], ["", "Compound 1", "comparison-X"], ["Ki (nM)", "5", "6"]]) for c, x in enumerate(row)],
    *[(None, r, c, x) for r, row in enumerate([["", "Compound 1"], ["Ki (nM)", "5"]]) for c, x in enumerate(row)],
    # a heading that comes twice, once blank, and a cell that comes twice
    *[("twice", 0, 0, ""), ("twice", 0, 0, "n"), ("twice", 0, 1, "Compound 2"), ("twice", 1, 0, ""), ("twice", 1, 0, "Ki (nM)"), ("twice", 1, 1, "7"), ("twice", 1, 1, "7")],
    *[("spoiled twice", 0, 0, ""), ("spoiled twice", 0, 0, ""), ("spoiled twice", 0, 1, "Compound 3"), ("spoiled twice", 0, 1, "Compound 3"), ("spoiled twice", 0, 2, "X"), ("spoiled twice", 1, 0, "Ki (nM)"), ("spoiled twice", 1, 1, "8")],
    # cells without a row or a column; a cell without a column spoils its row as any other one does
    *[("no row", 0, 0, ""), ("no row", 0, 1, "Compound 4"), ("no row", 1, 0, "Ki (nM)"), ("no row", 1, 1, "9"), ("no row", None, 0, "Ki (nM)"), ("no row", None, 1, "9"), ("no row", 1, None, "9")],
    *[("no column", 0, 0, ""), ("no column", 0, 1, "Compound 5"), ("no column", 1, 0, "Ki (nM)"), ("no column", 1, 1, "9"), ("no column", 2, None, "9")],
    *[("null heading", 0, 0, None), ("null heading", 0, 1, "Compound 6"), ("null heading", 0, 2, None), ("null heading", 1, 0, "Ki (nM)"), ("null heading", 1, 1, None)],
    *[("before the first", -1, 1, "over"), ("before the first", 0, 0, ""), ("before the first", 0, 1, "Compound 7"), ("before the first", 1, 0, "Ki (nM)"), ("before the first", 1, 1, "1")],
]
UNSUPPORTED = [("null heading", 2, None), ("sound", 2, "comparison-X"), ("spoiled twice", 2, "X")]


def odd_tables(spark):
    return spark.createDataFrame(ODD_TABLES, "t string, row int, col int, text string")


def test_unsupported_columns_of_odd_tables(spark):
    found = transposed.unsupported_columns(odd_tables(spark), ["t"]).collect()
    assert sorted((r["t"], r["col"], r["text"]) for r in found) == UNSUPPORTED


def test_header_rows_gather_nothing_by_row(spark):
    """A hash of all rows of all tables would have to fit or spill; what is gathered is a row for each table."""
    plan = transposed.header_rows(odd_tables(spark), ["t"])._jdf.queryExecution().sparkPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate(keys=" in line]
    assert grouped and all(line.partition("keys=")[2].partition("]")[0].count("#") == 1 for line in grouped), plan
    assert [line.partition("Join")[0].split()[-1] for line in plan.splitlines() if "LeftAnti" in line] == ["ShuffledHash"], plan


TURNED = [
    ("before the first", 1, 1, "Compound 7", "over Ki (nM)", None, "1", False),
    ("no row", 1, 1, "Compound 4", "Ki (nM)", None, "9", False),
    ("null heading", 1, 1, "Compound 6", "Ki (nM)", None, "", True),
    ("sound", 1, 2, "Compound 1", "Assay Ki (nM)", None, "5", False),
    *[("spoiled twice", 1, 1, "Compound 3", "Ki [column 1] (nM)", None, "8", False)] * 2,
]


def test_transposed_rows_of_odd_tables(spark, monkeypatch):
    """Cells meet headings and columns without being sorted, or written once more under their tables' headers."""
    plans = {}

    def cut(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return scratch.cut(df, name)

    monkeypatch.setattr(transposed, "cut", cut)
    assert sorted(map(tuple, transposed.transposed_rows(odd_tables(spark), ["t"]).collect()), key=str) == TURNED
    assert set(plans) == {"cells", "headers", "values"}
    joins_of = [line.partition("Join")[0].split()[-1] for line in plans["values"].splitlines() if "Join" in line and "Inner" in line]
    assert joins_of == ["ShuffledHash"] * len(joins_of) and len(joins_of) >= 4, plans["values"]


def plain_unit(text):
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[()（ ）]+|[()（ ）]+$", ""), r"(?U)\s+", "")
    return F.when(bare.rlike(f"^{headers.UNIT}$"), bare)


def plain_metric_text(header):
    """Every step on every text, one after the other."""
    text = F.translate(F.coalesce(header, F.lit("")), headers.GLYPHS, headers.PLAIN)
    for name in headers.SPACED:
        text = headers.without_gaps(text, name)
    text = F.regexp_replace(text, rf"(pIC50|(?<!p)IC50|EC50|DC50|GI50|CC50)(?=[fpnumµμ]?M{headers.END})", "$1 ")
    for name in headers.SPELLED:
        text = F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9]){headers.spaced(name)}{headers.END}", name)
    inner = lambda p: F.regexp_replace(p, r"^\(|\)$", "")
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"\([^()]*\)|\(|[^(]+"), F.lit(0)), lambda p: F.when(p.rlike(r"^\([^()]*\)$"), F.concat(F.lit("("), F.coalesce(plain_unit(inner(p)), F.trim(inner(p))), F.lit(")"))).otherwise(p))
    lines = F.split(F.array_join(parts, ""), r"\r?\n")
    return F.array_join(F.transform(lines, lambda x: F.coalesce(F.concat(F.lit("("), plain_unit(x), F.lit(")")), x)), "\n")


def test_repaired_headers_are_the_plain_ones(spark):
    rng = random.Random(7)
    pieces = [*"pICEDGKkdmaxYnlt50Ooic _()（）\n\t|;é²İ^3%", "nM", "uM", "µM", "IC50", "pIC50", "EC 5 O", "G I 5 0", "K i", "Kd", "C max", "Clint", "Y m i n", "CC50", "DC₅₀", "( n M )", "f M", "h", "\r\n", "F", "AUC0-t", "mL/min", "\u00a0", "\u3000", "mm"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(6000)]
    c = F.col("c")
    rows = spark.createDataFrame([(x,) for x in [*texts, *HEADERS]], "c string").select("c", plain_metric_text(c).alias("a"), headers.metric_text(c).alias("b"), plain_unit(c).alias("u"), headers.unit_of(c).alias("v"))
    assert rows.where("not (a <=> b and u <=> v)").limit(3).collect() == []
    assert rows.where("a <> coalesce(c, '')").count() > 1000


def test_headers_are_repaired_once_each(spark):
    """Units in a header's brackets come with its other readings, and prose is left out without reading its values."""
    pages = spark.createDataFrame([("a", "Cpd ID | IC50 (nM)\n1 | A\n2 | B"), ("b", "Cpd ID | IC50 (uM)\n1 | A"), ("c", "Cpd ID IC50 (nM)\n1 A\n2 mice were dosed"), ("c", "Cpd ID IC50 (nM)\n1 A\n2 mice were dosed"), (None, "Cpd ID | Ki\n1 | A")], "doc string, t string")
    legends = text_tables.grade_legends(pages.select("doc", F.lit(1).alias("n"), F.lit("letter codes for IC50 include: A (<10 nM), B (>10 nM)").alias("s")), ["doc"], "n", "s")
    rows = text_tables.table_rows(pages, ["doc"], "t", legends)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "translate(header" not in plan and not [line for line in plan.splitlines() if " Filter " in line and "transform(" in line], plan
    found = sorted((r["doc"] or "", r["line"], r["label"], r["legend"] is not None, r["needs_review"]) for r in rows.collect())
    assert found == [("a", 1, "1", True, False), ("a", 2, "2", True, False), ("b", 1, "1", False, True), ("c", 1, "1", False, True), ("c", 1, "1", False, True)]
