"""J queries: overlays, latest rows, tombstones, ranges, order, fuzzy identifiers, matched pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graphs, joins, overlays, pairs

from .registry import query, read


@query("j01_overlays", "select d.doc_id, d.lang, l.quality, c.n_bench from documents d left join labels l on d.doc_id = l.doc_id left join (select item_id as doc_id, length(text) as n_bench from benchmark) c on d.doc_id = c.doc_id")
def overlay(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "lang")
    bench = read(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").cast("long").alias("n_bench"))
    rows = overlays.overlaid(docs, {"l": read(spark, folder, "labels"), "c": bench}, ["doc_id"])
    return rows.select("doc_id", "lang", "l.quality", "c.n_bench")


@query("j02_latest_job", "select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderdate desc nulls last, o_orderkey desc) as n from customer left join orders on c_custkey = o_custkey) where n = 1")
def latest_job(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders")
    last = overlays.latest_value(orders, ["o_custkey"], F.col("o_orderkey"), F.struct("o_orderdate", "o_orderkey"), "o_orderkey")
    return read(spark, folder, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j03_preferred_alternative", "select p_partkey, tag from (select p_partkey, l_returnflag as tag, row_number() over (partition by p_partkey order by case l_returnflag when 'A' then 1 when 'R' then 2 else 9 end) as n from part left join (select distinct l_partkey, l_returnflag from lineitem where l_returnflag in ('A', 'R') and l_quantity > 40) on p_partkey = l_partkey) where n = 1")
def alternatives(spark: SparkSession, folder: str) -> DataFrame:
    found = read(spark, folder, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("tag")).distinct()
    wanted = read(spark, folder, "part").select("p_partkey")
    return overlays.preferred(wanted, found, "p_partkey", F.array(F.lit("A"), F.lit("R")), "tag")


@query("j04_anti_tombstone", "select o_orderkey from orders where o_orderkey % 10 <> 3 and o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def tombstones(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    deleted = orders.where("o_orderkey % 10 = 3")
    parents = read(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return overlays.live(orders, deleted, ["o_orderkey"], parents, ["o_custkey"]).select("o_orderkey")


@query("j05_jobs_datasets", "select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O'")
def jobs(spark: SparkSession, folder: str) -> DataFrame:
    open_ = read(spark, folder, "orders").where("o_orderstatus = 'O'")
    return open_.join(read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


PAIRS = "select a.p_partkey as reference_id, b.p_partkey as candidate_id, a.p_brand, a.p_type, a.p_size as rs, b.p_size as cs from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey <> b.p_partkey"


def brands(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type")


@query("j06_star_pairs", f"select p.reference_id, p.candidate_id, r.p_name as reference_name, c.p_name as candidate_name from ({PAIRS}) p join part r on r.p_partkey = p.reference_id join part c on c.p_partkey = p.candidate_id")
def star(spark: SparkSession, folder: str) -> DataFrame:
    names = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_name")
    rows = pairs.matched_pairs(pairs.with_rows(brands(spark, folder), names, "id"), ["p_brand", "p_type"], "id")
    return rows.select("reference_id", "candidate_id", F.col("reference_p_name").alias("reference_name"), F.col("candidate_p_name").alias("candidate_name"))


@query("j07_exact_pairs", "select s_suppkey, s_name, n_name from supplier join nation on s_nationkey = n_nationkey where s_suppkey in (select min(s_suppkey) from supplier group by s_nationkey)")
def exact(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = read(spark, folder, "supplier").groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("s_name"), F.min("s_suppkey").alias("s_suppkey"))
    nations = read(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.exact_pairs(suppliers, nations, ["s_nationkey"]).select("s_suppkey", "s_name", "n_name")


@query("j08_joined_repeats", "select o_custkey, string_agg(o_orderstatus, ' | ' order by o_orderkey) as states from orders group by o_custkey")
def repeats(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("states"))
    return joins.concatenated(rows, ["o_custkey"], ["o_orderkey"], "states")


@query("j09_source_cells", "select o.o_orderkey, l.l_linenumber from orders o left join lineitem l on o.o_orderkey = l.l_orderkey and l.l_returnflag = 'R' and l.l_quantity = 10")
def provenance(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").select("o_orderkey", F.lit("R").alias("field"), F.lit(10.0).alias("value"))
    cells = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("field"), F.col("l_quantity").alias("value"), "l_linenumber")
    return joins.with_provenance(rows, cells, ["o_orderkey"], "field", "value").select("o_orderkey", "l_linenumber")


NAMES = "select p_brand as doc, concat('Cpd-', cast(p_partkey as string)) as cpd from part where p_partkey % 3 <> 0"
SEEN = "select p_brand as doc, concat('Cpd-', cast(case when p_partkey % 5 = 0 then p_partkey + 1 else p_partkey end as string)) as cpd from part where p_partkey % 4 <> 1"


@query("j10_fuzzy_candidates", f"select distinct a.doc, a.cpd as original, b.cpd as suggested, cast(levenshtein(a.cpd, b.cpd) as int) as distance from ({SEEN}) a join ({NAMES}) b on a.doc = b.doc where abs(length(a.cpd) - length(b.cpd)) <= 2 and levenshtein(a.cpd, b.cpd) <= 2")
def fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part")
    known = parts.where("p_partkey % 3 <> 0").select(F.col("p_brand").alias("doc"), F.concat(F.lit("Cpd-"), F.col("p_partkey").cast("string")).alias("suggested"))
    seen = parts.where("p_partkey % 4 <> 1").select(F.col("p_brand").alias("doc"), F.concat(F.lit("Cpd-"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") + 1).otherwise(F.col("p_partkey")).cast("string")).alias("original"))
    return joins.fuzzy_candidates(seen, known, ["doc"])


@query("j10_reconciled_identifiers")
def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part")
    known = parts.where("p_partkey % 3 <> 0").select(F.col("p_brand").alias("doc"), F.concat(F.lit("Cpd-"), F.col("p_partkey").cast("string")).alias("cpd"))
    number = F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") + 1).otherwise(F.col("p_partkey"))
    seen = parts.where("p_partkey % 4 <> 1").select(F.col("p_brand").alias("doc"), F.concat(F.lit("Cpd-"), number.cast("string")).alias("cpd")).groupBy("doc", "cpd").agg(F.count("*").alias("n"))
    return joins.reconciled(seen, known, "doc")


@query("j11_points_in_cells", "select l_orderkey, l_linenumber, p_partkey as cell from lineitem join part on p_partkey = l_partkey where l_quantity >= p_size and l_quantity < p_size + 10 and l_discount * 100 >= 2 and l_discount * 100 < 6")
def points(spark: SparkSession, folder: str) -> DataFrame:
    tokens = read(spark, folder, "lineitem").select(F.col("l_partkey").alias("page"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    cells = read(spark, folder, "part").select(F.col("p_partkey").alias("page"), F.col("p_partkey").alias("cell"), F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 10).cast("double").alias("x1"), F.lit(2.0).alias("y0"), F.lit(6.0).alias("y1"))
    return joins.points_in_cells(tokens, cells, ["page"], 8.0).select("l_orderkey", "l_linenumber", "cell")


BOXES = "select p_brand as page, p_partkey as id, cast(p_size as double) as x0, cast(p_size + 1 as double) as x1, floor(p_retailprice / 100) as y0, floor(p_retailprice / 100) + 1 as y1 from part"


@query("j12_overlapping_boxes", f"with b as ({BOXES}) select a.id, c.id as b_id from b a join b c on a.page = c.page where a.id < c.id and a.x0 < c.x1 and c.x0 < a.x1 and a.y0 < c.y1 and c.y0 < a.y1")
def overlaps(spark: SparkSession, folder: str) -> DataFrame:
    boxes = read(spark, folder, "part").selectExpr("p_brand as page", "p_partkey as id", "p_size as x0", "p_size + 1 as x1", "floor(p_retailprice / 100) as y0", "floor(p_retailprice / 100) + 1 as y1")
    return joins.overlapping(boxes, boxes, ["page"]).where("id < b_id").select("id", "b_id")


@query("j13_owning_heading", "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as heading from conversations")
def heading(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations")
    return joins.carried(turns, ["conv_id"], ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("turn")), "heading").select("conv_id", "turn", "heading")


@query("j13_hot_heading", "select conv_id % 2 as half, conv_id, turn, last_value(case when role = 'system' then conv_id * 100 + turn end ignore nulls) over (partition by conv_id % 2 order by conv_id, turn, role, text rows between unbounded preceding and current row) as heading, row_number() over (partition by conv_id % 2 order by conv_id, turn, role, text) as number from conversations")
def hot_heading(spark: SparkSession, folder: str) -> DataFrame:
    """Two keys for all rows: each is sorted, carried and numbered in many parts."""
    turns = read(spark, folder, "conversations").withColumn("half", F.col("conv_id") % 2)
    order = ["conv_id", "turn", "role", "text"]
    headed = joins.carried_in_parts(turns, ["half"], order, F.when(F.col("role") == "system", F.col("conv_id") * 100 + F.col("turn")), "heading")
    return joins.numbered_in_parts(headed, ["half"], order).select("half", "conv_id", "turn", "heading", "number")


@query("j13_asof", "select e.event_id, (select max(o.event_id) from events o where o.event_type = 'purchase' and o.user_id = e.user_id and o.ts = (select max(p.ts) from events p where p.event_type = 'purchase' and p.user_id = e.user_id and p.ts <= e.ts)) as bought from events e where e.event_type = 'click'")
def asof(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("bought"))
    return joins.asof(events.where("event_type = 'click'"), bought, ["user_id"], "ts", "bought").select("event_id", "bought")


@query("j14_rows_in_order", "select a.c_nationkey as k, a.n as ordinal, c_custkey, s_suppkey from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as n from customer) a full join (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) as n from supplier) b on c_nationkey = s_nationkey and a.n = b.n where c_custkey is not null")
def ordered(spark: SparkSession, folder: str) -> DataFrame:
    a = read(spark, folder, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    b = read(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    rows = joins.in_order(a, b, ["k"], ["c_custkey"], ["s_suppkey"]).where("c_custkey is not null")
    return rows.select("k", F.col("ordinal").cast("long").alias("ordinal"), "c_custkey", "s_suppkey")


@query("j15_matched_pairs", f"select reference_id, candidate_id from ({PAIRS})")
def matched(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.matched_pairs(brands(spark, folder), ["p_brand", "p_type"], "id").select("reference_id", "candidate_id")


#: In the oracle: the letters of part names as chains, and each run of letters that may vary, with what stays on both sides.
CHAINS = "select distinct replace(p_name, ' ', '') as name from part"
RUNS = f"""c as ({CHAINS}), r as (select name, length(name) as n, i, unnest(range(i + 1, length(name) + 1)) as j from (select name, unnest(range(0, length(name))) as i from c)),
 k as (select name, array_to_string(list_sort(list_filter([reverse(left(name, i)), substr(name, j + 1)], lambda x: x <> '')), '|') as key from r where j - i <= 0.4 * n and n - (j - i) >= 6)"""


def chains(spark: SparkSession, folder: str) -> DataFrame:
    """(name, atoms, bonds): the distinct names of parts as chains of letters."""
    names = read(spark, folder, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("name")).distinct()
    bonds = F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda k: F.struct((k - 1).cast("int").alias("a"), k.cast("int").alias("b"), F.lit("single").alias("kind")))
    return names.select("name", F.split("name", "").alias("atoms"), bonds.alias("bonds"))


@query("j15_cut_keys", f"with {RUNS}, s as (select key from k group by key having count(distinct name) > 1) select name, count(*) as n_regions, count(*) filter (key in (select key from s)) as n_shared from k group by name")
def cut_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of letter chains that may vary, and how many leave a background that another name has."""
    keys = graphs.cut_keys(chains(spark, folder), "name", "atoms", "bonds")
    several = keys.groupBy("key").agg((F.min("name") < F.max("name")).alias("shared"))
    return keys.join(several, "key").groupBy("name").agg(F.count("*").alias("n_regions"), F.count_if("shared").alias("n_shared"))


@query("j16_verified_pairs", f"""with c as ({CHAINS}), p as (select a.name as reference, b.name as candidate, substr(a.name, 2) as fixed from c a join c b on length(a.name) = length(b.name) and a.name <> b.name)
 select reference, candidate, case when reference like 'hot%' then 'ineligible' else case cast(substr(candidate, 2) = fixed as int) + cast(left(candidate, length(candidate) - 1) = reverse(fixed) as int) when 0 then 'not_matched' when 1 then 'matched' else 'ambiguous' end end as result from p""")
def verified(spark: SparkSession, folder: str) -> DataFrame:
    """The first letter varies: does the rest of one name lie in another one of its length? Names with hot come without a region."""
    rows = chains(spark, folder).withColumn("n", F.length("name"))
    variable = F.when(F.col("reference_name").startswith("hot"), F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    found = pairs.matched_pairs(rows, ["n"], "name").withColumn("variable", variable)
    result = graphs.verified((F.col("reference_atoms"), F.col("reference_bonds"), F.col("variable")), (F.col("candidate_atoms"), F.col("candidate_bonds")))
    return found.select(F.col("reference_name").alias("reference"), F.col("candidate_name").alias("candidate"), result.alias("result"))


@query("j17_manual_region", "select r_regionkey, n_nationkey from region, nation where r_regionkey <> n_regionkey")
def manual_region(spark: SparkSession, folder: str) -> DataFrame:
    """All declared regions against all other rows, however many they are."""
    regions, nations = read(spark, folder, "region"), read(spark, folder, "nation")
    return nations.join(regions, F.col("r_regionkey") != F.col("n_regionkey")).select("r_regionkey", "n_nationkey")


@query("j18_members_in_view", "select p_brand, count(*) as n from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49) group by p_brand")
def in_view(spark: SparkSession, folder: str) -> DataFrame:
    chosen = read(spark, folder, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return pairs.restricted(read(spark, folder, "part"), chosen, "p_partkey").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("j19_coverage_gap", "select p_partkey, 'not published' as side from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 48)")
def gap(spark: SparkSession, folder: str) -> DataFrame:
    published = read(spark, folder, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return pairs.coverage_gap(published, read(spark, folder, "part"), ["p_partkey"])


@query("j20_aliases", "select c_custkey, first, n, conflict from customer join (select c_nationkey, c_mktsegment, min(c_custkey) as first, count(distinct c_custkey) as n, min(c_acctbal) < max(c_acctbal) as conflict from customer group by all having count(distinct c_custkey) > 1) using (c_nationkey, c_mktsegment)")
def alias_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "customer").withColumn("canonical", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    return pairs.aliases(rows, "canonical", "c_custkey", "c_acctbal").select("c_custkey", "first", "n", "conflict")


@query("j21_declared_conditions", "select doc_id, coalesce(case when lang = 'en' then null else lang end, case when source = 'src1' then 'xx' end) as lang, coalesce(source = 'src1' and lang <> 'en' and lang <> 'xx', false) as conflict from documents")
def declared(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    side = spark.createDataFrame([("src1", "xx")], "source string, lang string")
    return joins.declared(docs, side, ["source"], ["lang"]).select("doc_id", "lang", "conflict")


@query("j22_continued_tables", "with recursive l as (select p_partkey as node, case when p_partkey % 8 <> 0 then p_partkey - 1 end as parent from part), c(node, up, steps) as (select node, parent, 1 from l where parent is not null and parent > 0 union all select c.node, l.parent, c.steps + 1 from c join l on c.up = l.node where l.parent is not null and l.parent > 0) select node, min(up) as root, max(steps) as steps from c group by node")
def continued(spark: SparkSession, folder: str) -> DataFrame:
    parent = F.when((F.col("p_partkey") % 8 != 0) & (F.col("p_partkey") > 1), F.col("p_partkey") - 1)
    return joins.continued(read(spark, folder, "part").select(F.col("p_partkey").alias("node"), parent.alias("parent")))


@query("j_one_to_one_claims", "select o_orderkey, l_suppkey, case when s > 1 then 'ambiguous_compound_owner' when l > 1 then 'ambiguous_structure_owner' else 'accepted' end as verdict from (select distinct l_orderkey as o_orderkey, l_suppkey from lineitem) c left join (select l_orderkey, count(distinct l_suppkey) as s from lineitem group by 1) a on a.l_orderkey = c.o_orderkey left join (select l_suppkey as k, count(distinct l_orderkey) as l from lineitem group by 1) b on b.k = c.l_suppkey")
def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as labels and suppliers as structures."""
    rows = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    return joins.one_to_one(rows, "o_orderkey", "l_suppkey", F.lit(True))
