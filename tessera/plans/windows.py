"""W and U queries: orders, ranks, fronts, selections, runs, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.identifiers import natural_key
from tessera.operators import checks, overlays, pages, ranking

from .filters import CELL
from .registry import PRINTED, query, read


@query("w01_natural_order", f"select p_partkey, row_number() over (order by p_size % 4, k, p_partkey) as place from (select p_partkey, p_size, case when p_size % 4 = 2 then p_size * 10000000 + p_partkey else p_partkey end as k from part)")
def natural(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of one form each; within a form, natural order is numeric order."""
    parts = read(spark, folder, "part").select("p_partkey", (F.col("p_size") % 4).alias("form"), natural_key(F.expr(PRINTED)).alias("k"))
    return ranking.numbered(parts, [F.col("form"), F.col("k"), F.col("p_partkey")]).select("p_partkey", F.col("place").cast("long").alias("place"))


@query("w02_workbook_order", f"select l_orderkey, l_linenumber, row_number() over (order by v = '', case when regexp_full_match(v, '[0-9]+') then 2 when v = 'A' then 1 when v = '+++' then 3 else 4 end, try_cast(v as double), v, l_orderkey, l_linenumber) as place from (select l_orderkey, l_linenumber, {CELL} as v from lineitem)")
def workbook(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CELL).alias("v"))
    return ranking.numbered(*ranking.workbook_order(rows, "v", ["l_orderkey", "l_linenumber"])).select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("w03_midrank_percentile", "select event_id, round(case when n = 1 then 0.5 else (worse + (ties - 1) / 2.0) / (n - 1) end, 6) as percentile from (select event_id, rank() over (partition by event_type order by value desc) - 1 as worse, count(*) over (partition by event_type, value) as ties, count(*) over (partition by event_type) as n from events)")
def midrank(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.operators.statistics import midrank as ranked

    return ranked(read(spark, folder, "events"), ["event_type"], "value").select("event_id", F.round("percentile", 6).alias("percentile"))


@query("w04_band_first", "select p_partkey, row_number() over (order by case when p_retailprice < 1000 then 0 else 1 end, p_partkey) as place from part")
def band_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "part").select("p_partkey", "p_retailprice")
    return ranking.numbered(rows, [F.when(F.col("p_retailprice") < 1000, 0).otherwise(1), F.col("p_partkey")]).select("p_partkey", F.col("place").cast("long").alias("place"))


@query("w05_study_order", "select c_custkey, row_number() over (order by c_acctbal < 0, case when c_acctbal < 0 then null else floor(c_acctbal / 100) end desc, c_custkey) as place from customer")
def study_order(spark: SparkSession, folder: str) -> DataFrame:
    """Unknown values (here: negative) last; descending, ties stay in the labels' order."""
    rows = read(spark, folder, "customer").select("c_custkey", "c_acctbal")
    known = F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100))
    keyed, order = ranking.study_order(rows, F.concat(F.lit("I-"), F.col("c_custkey").cast("string")), "c_custkey", known, descending=True)
    return ranking.numbered(keyed, order).select("c_custkey", F.col("place").cast("long").alias("place"))


@query("w05_label_order", "select c_custkey, row_number() over (order by c_custkey % 10 desc, c_custkey desc) as place from customer")
def label_order(spark: SparkSession, folder: str) -> DataFrame:
    """By the label alone, both label and identity turn with the direction."""
    rows = read(spark, folder, "customer").select("c_custkey")
    keyed, order = ranking.study_order(rows, F.concat(F.lit("I-"), (F.col("c_custkey") % 10).cast("string")), "c_custkey", descending=True)
    return ranking.numbered(keyed, order).select("c_custkey", F.col("place").cast("long").alias("place"))


@query("w06_page", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def page(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.page_of(read(spark, folder, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 50)


@query("w07_latest_per_key", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest(spark: SparkSession, folder: str) -> DataFrame:
    return overlays.latest(read(spark, folder, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("w08_fifo_claim", "select o_orderstatus, arg_min(o_orderkey, o_orderdate::varchar || lpad(o_orderkey::varchar, 12, '0')) as o_orderkey from orders group by 1")
def fifo(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").groupBy("o_orderstatus").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("w09_first_front", "select p_brand, p_partkey from part a where not exists (select 1 from part b where b.p_brand = a.p_brand and b.p_retailprice <= a.p_retailprice and b.p_size >= a.p_size and (b.p_retailprice < a.p_retailprice or b.p_size > a.p_size))")
def first_front(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.pareto_front(read(spark, folder, "part"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", "p_partkey")


#: In the oracle: the fronts of distinct vectors; each vector gets every length of a chain of vectors that dominate it.
DEPTHS = """v as (select distinct {groups}, {costs} from {rows}),
 d as (select {pairs}, b.* from v a join v b using ({groups}) where {all} and {any}),
 c as (select {groups}, {costs}, 1 as depth from v union select {groups}, {qualified}, c.depth + 1 from c join d using ({groups}) where {joined}),
 f as (select {groups}, {costs}, max(depth) as front from c group by all)"""


def depths_sql(rows: str, groups: list[str], costs: list[tuple[str, str]]) -> str:
    """Common table expressions that end with f: groups, cost columns, front."""
    names = [c for pair in dict.fromkeys(costs) for c in dict.fromkeys(pair)]
    below = [f"a.{high} < b.{low}" for low, high in costs]
    same = [f"(a.{low} = b.{low} and a.{high} = b.{high} and a.{low} = a.{high})" for low, high in costs]
    return DEPTHS.format(rows=rows, groups=", ".join(groups), costs=", ".join(names), pairs=", ".join(f"a.{n} as over_{n}" for n in names), all=" and ".join(f"({x} or {y})" for x, y in zip(below, same)), any=f"({' or '.join(below)})", qualified=", ".join(f"d.{n}" for n in names), joined=" and ".join(f"c.{n} = d.over_{n}" for n in names))


VECTORS = "select p_brand, p_partkey, p_retailprice as a, cast(-p_size as double) as c, cast(2 - p_size as double) as d from part"


@query("w09_pareto_depths", f"with recursive r as ({VECTORS}), {depths_sql('r', ['p_brand'], [('a', 'a'), ('c', 'd')])} select r.p_brand, r.p_partkey, cast(f.front as bigint) as front from r join f using (p_brand, a, c, d)")
def depths(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("a"), F.col("p_retailprice").alias("b"), (-F.col("p_size")).cast("double").alias("c"), (F.lit(2) - F.col("p_size")).cast("double").alias("d"))
    return ranking.pareto_depths(rows, ["p_brand"], "p_partkey", [("a", "b"), ("c", "d")])


#: Predictions and properties of parts, with gaps; c is out of range and counts as unknown.
EVIDENCE = "select p_partkey, p_size % 4 as front, case when p_partkey % 4 <> 0 then p_size % 10 / 10e0 end as a, case when p_partkey % 3 <> 0 then p_partkey % 7 / 7e0 end as b, case when p_partkey % 5 = 0 then 1.5e0 end as c, p_partkey % 9 <> 0 as verified, p_retailprice - 400e0 as weight, case when p_size % 3 <> 0 then p_size % 9 * 1e0 end as logp, p_size * 5e0 as surface, case when p_partkey % 2 = 0 then 1e0 end as donors, 1e0 as acceptors from part"


@query("w10_evidence_fronts", f"""with recursive e as ({EVIDENCE}),
 r as (select p_partkey, front as g, cast(a is not null as int) + 2 * cast(b is not null as int) as n, coalesce(a, 0) as a, coalesce(-b, 0) as e from e where verified and (a is not null or b is not null)),
 {depths_sql('r', ['g', 'n'], [('a', 'a'), ('e', 'e')])},
 o as (select r.p_partkey, cast(f.front as bigint) as own from r join f using (g, n, a, e))
 select e.p_partkey, case when verified and (a is not null or b is not null) then 0 else 1 end as unverified, case when own is null then 0 else -cast(a is not null as int) - cast(b is not null as int) end as neg_endpoints, coalesce(own, 0) as own_front,
 -(2 + cast(logp is not null as int) + cast(donors is not null as int) + 1) as neg_coverage, case when weight > 800 or coalesce(logp, 0) > 6 or surface > 200 then 1 else 0 end as review from e left join o on o.p_partkey = e.p_partkey""")
def evidence_fronts(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.sql(EVIDENCE.replace("from part", "from {part}"), part=read(spark, folder, "part"))
    rows = rows.withColumn("predictions", F.create_map(*[x for k in "abc" for x in (F.lit(k), F.col(k))]))
    return ranking.secondary_evidence(rows, "p_partkey", "front", "predictions", {"a": "lower", "b": "higher", "c": "lower"}, F.col("verified"), [F.col(c) for c in ("weight", "logp", "surface", "donors", "acceptors")])


def greedy_sql(base: str, similarity: str, first: str, later: str, order: str, columns: str, gone: str, k: int = 8) -> str:
    """k picks, one after the other: base has id, v and norm; similarity is that of a row b to the pick p."""
    parts = [f"base as ({base}), p1 as (select b.*, {first} from base b order by {order.format(near='0')} limit 1)"]
    for n in range(2, k + 1):
        near = f"greatest({', '.join(f'(select {similarity} from p{j} p)' for j in range(1, n))})" if n > 2 else f"(select {similarity} from p1 p)"
        picks = " union all ".join(f"select * from p{j}" for j in range(1, n))
        parts.append(f"p{n} as (select b.*, {later.format(near=near, picks=picks)} from base b where {gone.format(picks=picks)} order by {order.format(near=near)} limit 1)")
    return "with " + ", ".join(parts) + " select " + columns.format(n="1") + " from p1" + "".join(f" union all select {columns.format(n=n)} from p{n}" for n in range(2, k + 1))


COSINE = "list_inner_product(b.v, p.v) / (b.norm * p.norm)"
DIVERSE = greedy_sql(
    "select vec_id as id, cast(vec_id % 97 as double) as q, cast(embedding as double[]) as v, sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) as norm, cast(label as varchar) as s from embeddings",
    f"greatest(0, least(1, {COSINE}))", "0.8 * q + 20e0 as score", "0.8 * q + 20 * (0.7 * (1 - {near}) + 0.3 * case when b.s in (select s from ({picks})) then 0 else 1 end) as score", "score desc, id", "id as vec_id, cast({n} as bigint) as pick, score", "b.id not in (select id from ({picks}))",
)


@query("w11_diverse_top", DIVERSE)
def diverse(spark: SparkSession, folder: str) -> DataFrame:
    pool = read(spark, folder, "embeddings").withColumn("quality", F.col("vec_id") % 97)
    return ranking.diverse_top(pool, "vec_id", "quality", "embedding", scaffold="label")


CANDIDATES = greedy_sql(
    "select vec_id as id, vec_id // 2 as m, vec_id % 3 as front, -(label % 4) as cov, case when vec_id % 5 <> 0 then cast(embedding as double[]) end as v, case when vec_id % 5 <> 0 then sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) end as norm from embeddings where vec_id % 3 <> 2",
    COSINE, "0 as near", "round({near}, 12) as near", "front, cov, case when {near} is null then 1 else 0 end, round({near}, 12), id", "id as vec_id, cast({n} as bigint) as pick", "b.m not in (select m from ({picks}))",
)


@query("w12_candidate_selection", CANDIDATES)
def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Front, then coverage, then the least similar to what is chosen; some vectors are unknown, two rows share a molecule, and rows without a front stay out."""
    rows = read(spark, folder, "embeddings").select("vec_id", F.expr("vec_id div 2").alias("m"), F.expr("case when vec_id % 3 <> 2 then vec_id % 3 end").alias("front"), (-(F.col("label") % 4)).alias("cov"), F.expr("case when vec_id % 5 <> 0 then embedding end").alias("v"))
    return ranking.select_candidates(rows, "vec_id", "m", ["front", "cov"], "v")


@query("w13_nth_statistic", "select l_suppkey, l_quantity as tenth from (select l_suppkey, l_quantity, row_number() over (partition by l_suppkey order by l_quantity, l_orderkey, l_linenumber) as n from lineitem) where n = 10")
def nth(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_quantity", "l_orderkey", "l_linenumber")))
    return rows.where("n = 10").select("l_suppkey", F.col("l_quantity").alias("tenth"))


@query("w14_runs", "select conv_id, turn, sum(b) over (partition by conv_id order by turn rows unbounded preceding)::bigint as run from (select conv_id, turn, case when lag(role) over w is null or lag(role) over w = role then 1 else 0 end as b from (select conv_id, turn, min(role) as role from conversations group by 1, 2) window w as (partition by conv_id order by turn))")
def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a conversation in which roles alternate."""
    turns = read(spark, folder, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    broken = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")) == F.col("role")
    return pages.runs(turns, ["conv_id"], "turn", broken).select("conv_id", "turn", F.col("run").cast("long").alias("run"))


@query("w14_extended_pages")
def extended(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the pages of their source: tables continue until something stops them."""
    rows = pages.classified(read(spark, folder, "documents").select("source", "doc_id", "text"), "text")
    return pages.extended(rows, "source", "doc_id").select("source", "doc_id", "activity", "synthesis")


@query("w15_candidate_window", "select source, greatest(min(doc_id), coalesce(min(doc_id) filter (n_chars > 20000), min(doc_id)) - 2) as first, least(max(doc_id), coalesce(max(doc_id) filter (n_chars > 20000) + 2, max(doc_id))) as last from documents group by source")
def window(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select("source", "doc_id", (F.col("n_chars") > 20000).alias("activity"), F.lit(False).alias("synthesis"), F.lit(False).alias("stops"))
    return pages.candidate_window(rows, "source", "doc_id")


@query("w16_clusters", "select l_partkey, l_orderkey, l_linenumber, (1 + sum(g) over (partition by l_partkey order by l_quantity range unbounded preceding))::bigint as cluster from (select *, case when l_quantity - lag(l_quantity) over (partition by l_partkey order by l_quantity) > 3 then 1 else 0 end as g from lineitem)")
def clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return pages.clustered(rows, ["l_partkey"], "l_quantity", 3.0).select("l_partkey", "l_orderkey", "l_linenumber", F.col("cluster").cast("long").alias("cluster"))


@query("w17_cumulative", "select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as running from orders")
def cumulative(spark: SparkSession, folder: str) -> DataFrame:
    upto = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return read(spark, folder, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(upto), 2).alias("running"))


@query("u01_set_differences", "select k, 'extra' as side from (select distinct l_partkey as k from lineitem where l_quantity = 50 except select p_partkey from part where p_size < 25) union all select k, 'missing' from (select p_partkey as k from part where p_size < 25 except select l_partkey from lineitem where l_quantity = 50)")
def differences(spark: SparkSession, folder: str) -> DataFrame:
    seen = read(spark, folder, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("k"))
    known = read(spark, folder, "part").where("p_size < 25").select(F.col("p_partkey").alias("k"))
    return checks.set_differences(seen, known, "k")


@query("u02_other_pages", "select doc_id from documents where lang <> 'en' and source <> 'src1'")
def others(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "lang", "source")
    rest = docs.select("doc_id").join(docs.where("lang = 'en'").select("doc_id"), "doc_id", "left_anti")
    return rest.join(docs.where("source = 'src1'").select("doc_id"), "doc_id", "left_anti")


@query("u03_union_of_candidates", "select l_partkey as k from lineitem where l_quantity = 1 union select p_partkey from part where p_size = 1 union select p_partkey from part where p_retailprice > 1990")
def union(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice")
    lines = read(spark, folder, "lineitem").where("l_quantity = 1").select(F.col("l_partkey").alias("k"))
    return lines.unionByName(parts.where("p_size = 1").select("k")).unionByName(parts.where("p_retailprice > 1990").select("k")).distinct()


@query("u04_intersection", "select p_partkey as k from part where p_size < 20 intersect select l_partkey from lineitem where l_quantity = 50")
def intersection(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("k"))
    return read(spark, folder, "part").where("p_size < 20").select(F.col("p_partkey").alias("k")).intersect(lines)


@query("u05_ordered_distinct", "select p_partkey, string_agg(w, ' ' order by i) as words from (select p_partkey, w, min(i) as i from (select p_partkey, unnest(string_split(p_name || ' ' || p_name, ' ')) as w, generate_subscripts(string_split(p_name || ' ' || p_name, ' '), 1) as i from part) group by 1, 2) group by 1")
def ordered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_name"), " "))
    return read(spark, folder, "part").select("p_partkey", F.array_join(words, " ").alias("words"))


@query("u06_bag_union", "select c_nationkey as k, count(*) as n from (select c_nationkey from customer union all select s_nationkey from supplier) group by 1")
def bag(spark: SparkSession, folder: str) -> DataFrame:
    a, b = read(spark, folder, "customer").select(F.col("c_nationkey").alias("k")), read(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.unionByName(b).groupBy("k").agg(F.count("*").alias("n"))


@query("u07_sequence_differences", "select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn) as turn, a.role as left, b.role as right from (select conv_id, turn, min(role) as role from conversations group by 1, 2) a full join (select conv_id, turn - 1 as turn, min(role) as role from conversations where turn > 0 group by 1, 2) b on a.conv_id = b.conv_id and a.turn = b.turn where a.role is distinct from b.role")
def sequences(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    ahead = turns.where("turn > 0").withColumn("turn", F.col("turn") - 1)
    return checks.sequence_differences(turns, ahead, ["conv_id"], "turn", "role").select("conv_id", "turn", "left", "right")


@query("u08_mapping_conflicts", "select 's_nationkey' as side, cast(s_nationkey as string) as value, count(distinct s_suppkey) as n from supplier group by s_nationkey having count(distinct s_suppkey) > 1")
def mapping(spark: SparkSession, folder: str) -> DataFrame:
    return checks.mapping_conflicts(read(spark, folder, "supplier"), "s_nationkey", "s_suppkey")


@query("u_repeated_keys", "select l_orderkey, l_suppkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def repeated(spark: SparkSession, folder: str) -> DataFrame:
    return checks.repeated(read(spark, folder, "lineitem"), ["l_orderkey", "l_suppkey"])
