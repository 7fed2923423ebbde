"""Queries of documents: turned tables, text tables, located pages, shared parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sections
from tessera.functions.structures import structure_signals
from tessera.operators import joins, pages, text_tables, transposed
from tessera.sources import shared
from tessera.sources.scratch import spread

from .registry import query, read

#: Lines, one for each order and number.
LINES = "(select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity, min(l_tax) as l_tax, min(l_discount) as l_discount from lineitem group by l_orderkey, l_linenumber)"
#: One turned table for each order: a merged heading over its lines, the lines' compounds, two metrics and a count.
CELLS = f"""
with lines as {LINES}, o as (select distinct l_orderkey from lineitem),
h as (select l_orderkey, cast(r as int) as row_no, 0 as col, case r when 2 then 'IC50 (nM)' when 3 then case when l_orderkey % 5 = 0 then 'Remarks' else 'Imax (%)' end when 4 then 'n' else '' end as text from o cross join (select 0 as r union all select 1 union all select 2 union all select 3 union all select 4) x),
c as (select l_orderkey, l_linenumber as col, l_partkey, case l_suppkey % 4 when 0 then concat('Compound ', cast(l_partkey as string)) when 1 then concat('Ref. ', cast(l_linenumber as string)) when 2 then 'comparison-X' else concat('Cpd-', cast(l_partkey as string), 'b') end as head,
 case l_linenumber when 1 then 'Assay A' when 3 then 'Assay B' end as over, cast(cast(l_quantity as bigint) as string) as a, case when l_tax = 0 then 'about 3' else cast(cast(round(l_discount * 100) as bigint) as string) end as b from lines)
select l_orderkey, row_no as row, col, text from h union all select l_orderkey, 0, col, over from c union all select l_orderkey, 1, col, head from c union all select l_orderkey, 2, col, a from c union all select l_orderkey, 3, col, b from c union all select l_orderkey, 4, col, '3' from c
"""
DECLARED = "case l_suppkey % 4 when 0 then 'Compound ' || l_partkey when 1 then 'Ref. ' || l_linenumber when 3 then 'Compound ' || l_partkey || 'B' end"


@query(
    "n_transposed_rows",
    f"""with d as (select *, {DECLARED} as cpd, coalesce(title, '') as t from (select *, last_value(case l_linenumber when 1 then 'Assay A ' when 3 then 'Assay B ' end ignore nulls) over (partition by l_orderkey order by l_linenumber rows unbounded preceding) as title from {LINES}) where l_orderkey % 5 <> 0)
 select l_orderkey, l_linenumber as col, 2 as row, cpd, t || 'IC50 (nM)' as field, null as count, cast(l_quantity::bigint as varchar) as value, false as needs_review from d where cpd is not null
 union all select l_orderkey, l_linenumber, 3, cpd, t || 'Imax (%)', null, case when l_tax = 0 then 'about 3' else cast(round(l_discount * 100)::bigint as varchar) end, l_tax = 0 from d where cpd is not null
 union all select l_orderkey, l_linenumber, 4, cpd, 'Unknown activity field 3: ' || t || 'n (unit unknown)', 'reported_n', '3', false from d where cpd is not null""",
)
def transposed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A row of remarks under the compounds makes a table another kind of table; it gives nothing."""
    cells = spark.sql(CELLS.replace("from lineitem", "from {lineitem}"), lineitem=read(spark, folder, "lineitem"))
    return transposed.transposed_rows(cells, ["l_orderkey"])


@query("n_unsupported_columns", f"select l_orderkey, l_linenumber as col, 'comparison-X' as text, 'unsupported_header' as reason from {LINES} where l_orderkey % 5 <> 0 and l_suppkey % 4 = 2 and l_orderkey in (select l_orderkey from {LINES} where {DECLARED} is not null)")
def unsupported(spark: SparkSession, folder: str) -> DataFrame:
    cells = spark.sql(CELLS.replace("from lineitem", "from {lineitem}"), lineitem=read(spark, folder, "lineitem"))
    return transposed.unsupported_columns(cells, ["l_orderkey"])


#: Pages with what they show: evidence by themselves, ways to continue one, a stop, or nothing.
PAGE_TEXTS = ("Table 1. Compound No. Structure\nI-1 I-2", "Example 12 was stirred", "1. NH left 2. OH right", "The mixture was stirred and purified", "1. NH was stirred 2. OH", "BACKGROUND of the art", "Some other words", "")
PAGE_KIND = "(conv_id * 7 + turn * 5 + length(text)) % 11"


@query(
    "w_located_pages",
    f"""with recursive p as (select conv_id, turn as page, least({PAGE_KIND}, 9) % 8 as k, turn % 3 <> 0 as syn from conversations where (conv_id + turn) % 9 <> 0),
 s as (select conv_id, page, case k when 0 then 't' else 'c' end as kind from p where k < 2),
 ok as (select conv_id, page, k in (2, 4) as t, k in (3, 4) and syn as c from p where k >= 2),
 l as (select * from s union all select ok.conv_id, ok.page, l.kind from l join ok on ok.conv_id = l.conv_id and ok.page = l.page - 1 and case l.kind when 't' then ok.t else ok.c end),
 r as (select * from s union all select ok.conv_id, ok.page, r.kind from r join ok on ok.conv_id = r.conv_id and ok.page = r.page + 1 and case r.kind when 't' then ok.t else ok.c end where (ok.conv_id, ok.page) not in (select (conv_id, page) from l)),
 f as (select conv_id, page, kind from l union select conv_id, page, kind from r)
 select conv_id, page, case when (conv_id, page) in (select (conv_id, page) from s) then case kind when 't' then 'numbered_structure_table' else 'numbered_synthesis_or_caption' end when kind = 't' then 'structure_table_continuation' else 'synthesis_continuation' end as evidence from f""",
)
def located(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of conversations as pages, some of them missing."""
    text = F.element_at(F.array(*[F.lit(t) for t in PAGE_TEXTS]), F.expr(f"cast(least({PAGE_KIND}, 9) % 8 + 1 as int)"))
    rows = read(spark, folder, "conversations").where("(conv_id + turn) % 9 <> 0").select("conv_id", F.col("turn").alias("page"), text.alias("shown"), (F.col("turn") % 3 != 0).alias("syn"))
    return pages.located(rows.withColumns(structure_signals(F.col("shown"))), "conv_id", "page", "syn")


@query(
    "s05_shared_graphs",
    """with s as (select s_nationkey as g, s_suppkey % 3 as m, s_suppkey as k, '{"s":' || s_suppkey || ',"lit":{"$shared":"x"}}' as leaf from supplier),
 m as (select g, m, '[' || string_agg(leaf, ',' order by k) || ']' as mid from s group by g, m)
 select g as graph, case when g % 6 in (0, 5) then '{"all":[' || string_agg(mid, ',' order by m) || ']}' end as value, case g % 6 when 1 then 'missing_reference' when 2 then 'cycle' when 3 then 'unreachable' when 4 then 'identity' end as refusal from m group by g""",
)
def shared_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers in parts of three, each part a reference to references; four of six graphs are broken, each in another way."""
    ref = lambda key: F.concat(F.lit('{"$shared":"'), key, F.lit('"}'))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c]), ","), F.lit("]"))
    made = lambda lit: F.concat(F.lit('{"s":'), F.col("k").cast("string"), F.lit(f',"lit":{lit}}}'))
    leaves = read(spark, folder, "supplier").select(F.col("s_nationkey").alias("graph"), (F.col("s_suppkey") % 3).alias("m"), F.col("s_suppkey").alias("k"))
    leaves = leaves.withColumn("value", made('{"$literal":{"$shared":"x"}}')).withColumn("whole", made('{"$shared":"x"}')).withColumn("token", ref(F.sha2("whole", 256)))
    mids = leaves.groupBy("graph", "m").agg(listed("token").alias("value"), listed("whole").alias("whole"))
    wrong = lambda n: F.col("graph") % 6 == n
    mids = mids.withColumn("k", F.col("m")).withColumn("key", F.when(wrong(4), F.concat(F.lit("zz"), F.col("m").cast("string"))).otherwise(F.sha2("whole", 256))).withColumn("token", ref(F.col("key")))
    roots = mids.groupBy("graph").agg(listed("token").alias("all"))
    more = F.when(wrong(1), F.concat(F.lit(',"more":'), ref(F.lit("nope")))).when(wrong(2), F.concat(F.lit(',"more":'), ref(F.lit("c1")))).otherwise("")
    payloads = roots.select("graph", F.concat(F.lit('{"all":'), F.col("all"), more, F.lit("}")).alias("value"))
    graphs = roots.select("graph")
    ring = graphs.where(wrong(2)).select("graph", F.explode(F.array(*[F.struct(F.lit(a).alias("key"), F.lit(b).alias("to")) for a, b in (("c1", "c2"), ("c2", "c1"))])).alias("r")).select("graph", "r.key", F.concat(F.lit("["), ref(F.col("r.to")), F.lit("]")).alias("value"))
    alone = graphs.where(wrong(3)).select("graph", F.lit("alone").alias("key"), F.lit("[1]").alias("value"))
    catalogue = leaves.select("graph", F.sha2("whole", 256).alias("key"), "value").union(mids.select("graph", "key", "value")).union(ring).union(alone)
    return shared.decoded(catalogue, payloads)


@query(
    "n23_segments",
    """select o_orderkey, 1 as segment, 1 as line, 'Compound ' || o_custkey as cpd, cast(o_orderkey % 97 as varchar) as value, o_orderkey % 4 = 0 as explained from orders
 union all select o_orderkey, 1, 2, 'Compound ' || o_custkey || 'A', 'A', o_orderkey % 4 = 0 from orders
 union all select o_orderkey, 2, 7, 'Compound X-' || o_custkey, '>' || (o_orderkey % 7), false from orders where o_orderkey % 3 <> 0
 union all select o_orderkey, 2, 7, 'Compound Y-' || o_custkey, 'ND', false from orders where o_orderkey % 3 <> 0""",
)
def segmented(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables on each page, the second under a header of two lines with two rows in one line; some pages explain the first one's grades."""
    key, custom = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    first = F.concat(F.lit("Cpd No. | IC50 (nM)\n"), custom, F.lit(" | "), (key % 97).cast("string"), F.lit("\nCpd "), custom, F.lit("a | A\n* stop\n7 | 8\n"))
    second = F.when(key % 3 != 0, F.concat(F.lit("Compound ID\nKi (nM)\nCompound X-"), custom, F.lit(" >"), (key % 7).cast("string"), F.lit(" Compound Y-"), custom, F.lit(" ND\nCompound Z-1 was given"))).otherwise("Compound ID\nname\nX-1 5")
    legend = F.when(key % 4 == 0, "letter codes for IC50 include: A (<10 nM), B (>10 nM)").otherwise("")
    orders = read(spark, folder, "orders")
    pages = orders.select("o_orderkey", F.concat(first, second).alias("page"))
    legends = text_tables.grade_legends(orders.select("o_orderkey", F.lit(0).alias("n"), legend.alias("said")), ["o_orderkey"], "n", "said")
    rows = text_tables.table_rows(pages, ["o_orderkey"], "page", legends)
    return rows.select("o_orderkey", "segment", "line", "cpd", F.get(F.map_values("values"), F.lit(0)).alias("value"), F.col("legend").isNotNull().alias("explained"))


@query(
    "n21_heading_members",
    """with h as (select p_partkey as k, p_size % 6 as c from part),
 m as (select k, 0 as line, 0 as place, cast(k as varchar) as identifier, case c when 2 then 'example' else 'compound' end as kind, case c when 2 then 'assay_section' when 3 then 'intermediate_section' else 'compound_heading' end as role from h where c < 4
 union all select k, 0, 1, cast(k + 1 as varchar) || 'A', 'compound', 'compound_heading' from h where c = 1),
 o as (select k, line, place, identifier, kind, role from m union all select k, 1, place, identifier, kind, role from m)
 select k as p_partkey, line, cast(place as int) as place, identifier, kind, role from o union all select k, 2, 0, 'X-' || k, 'example', 'ambiguous_heading' from h""",
)
def heading_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a part's page with the members of the heading that owns it: one compound, a group, an assay, an intermediate, prose or a range."""
    k = F.col("p_partkey").cast("string")
    forms = [F.concat(F.lit("[0012] Compound "), k, F.lit(": Preparation")), F.concat(F.lit("Compounds "), k, F.lit(" and "), (F.col("p_partkey") + 1).cast("string"), F.lit("a: Synthesis")), F.concat(F.lit("Example "), k, F.lit(": HTRF assay")), F.concat(F.lit("Intermediate Compound "), k), F.concat(F.lit("Compound "), k, F.lit(" was stirred")), F.concat(F.lit("Compounds "), k, F.lit(" to 99999"))]
    first = F.get(F.array(*forms), F.col("p_size") % 6)
    lines = F.array(first, F.lit("5 mg of it was used."), F.concat(F.lit("Example X-"), k, F.lit(": Synthesis of a probe for the assay")))
    pages = spread(read(spark, folder, "part"), "p_partkey").select("p_partkey", F.posexplode(lines).alias("line", "text"))
    read_ = joins.carried(pages, ["p_partkey"], ["line"], sections.section_heading(F.col("text")), "h").where("h is not null")
    return read_.select("p_partkey", "line", F.posexplode("h.members").alias("place", "identifier"), "h.kind", "h.role")
