"""A queries: summaries, scales, histograms, scores, merges and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import contexts
from tessera.functions import numbers as N
from tessera.operators import checks, facets, graphs, merging, pages, pairs, scores, statistics
from tessera.operators.filters import Filter
from tessera.sources import tables

from .filters import CELL
from .registry import OBSERVED, observed, query, read

KEYS = ["flag", "status"]
#: In the oracle: the interval of each observation's source string, infinite where it is open-ended.
INTERVALS = f"""o as (select subject, flag, status, raw, case when raw = 'ND' then 'missing' when raw like '[%' or raw like '>%' or raw like '<%' then 'interval' else 'scalar' end as kind,
  case when raw = 'ND' then null when raw like '<%' then -1e300 when raw like '>%' then cast(substr(raw, 2) as double) when raw like '[%' then cast(string_split(trim(raw, '[]'), ',')[1] as double) else cast(raw as double) end as lo,
  case when raw = 'ND' then null when raw like '>%' then 1e300 when raw like '<%' then cast(substr(raw, 2) as double) when raw like '[%' then cast(string_split(trim(raw, '[]'), ',')[2] as double) else cast(raw as double) end as hi,
  raw not like '>%' and raw not like '<%' as closed from ({OBSERVED}))"""


@query("a01_evidence_summary", f"select flag, status, count(*) as n_rows, count(try_cast(raw as double)) as n_numeric, min(try_cast(raw as double)) as min_value, max(try_cast(raw as double)) as max_value, count(*) filter (raw like '>%' or raw like '<%') as n_censored from ({OBSERVED}) group by flag, status")
def evidence(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.evidence_summary(observed(spark, folder), KEYS, "raw")


@query("a02_context_catalogue", f"with o as ({OBSERVED}), v as (select distinct flag, status, raw from o), n as (select *, row_number() over (partition by flag, status order by raw) as i from v) select o.flag, o.status, count(*) as n_observations, count(distinct raw) as n_values, count(distinct subject) as n_subjects, any_value(s.samples) as samples from o join (select flag, status, string_agg(raw, '|' order by raw) as samples from n where i <= 32 group by 1, 2) s on s.flag = o.flag and s.status = o.status group by o.flag, o.status")
def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    rows = statistics.context_catalogue(observed(spark, folder), KEYS, "subject", "raw")
    return rows.select(*KEYS, "n_observations", "n_values", "n_subjects", "samples")


@query("a03_facet", f"with c as (select l_partkey as id, {CELL} as v from lineitem), d as (select distinct id, v from c where v <> ''), e as (select v as value, count(*) as n from d group by v union all select null, count(*) from (select id from c group by id having count(*) filter (v <> '') = 0) having count(*) > 0) select value, n from e")
def facet(spark: SparkSession, folder: str) -> DataFrame:
    from .filters import cells

    return facets.facet(cells(spark, folder), "cell")


@query("a03_facet_self_excluding", f"with c as (select l_partkey as id, {CELL} as v from lineitem), d as (select distinct id, v from c where v <> '' and id in (select p_partkey from part where p_size > 25)) select v as value, count(*) as n from d group by v")
def facet_excluding(spark: SparkSession, folder: str) -> DataFrame:
    """The cell column's choices under the other column's filter; its own filter is left out."""
    from .filters import cells

    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("string")).alias("size"))
    table = cells(spark, folder).join(parts, "id")
    filters = [Filter("cell", "in", values=("A",)), Filter("size", "gt", 25)]
    return facets.facet_of(table, "cell", filters, {"cell": "text", "size": "text"}).where("value is not null")


@query("a04_facet_kind", f"with d as (select distinct l_partkey, {CELL} as v from lineitem where {CELL} <> '') select count(*) filter (regexp_full_match(v, '[0-9]+')) as n_numbers, count(*) filter (not regexp_full_match(v, '[0-9]+')) as n_texts, case when count(*) filter (regexp_full_match(v, '[0-9]+')) > count(*) filter (not regexp_full_match(v, '[0-9]+')) then 'number' else 'text' end as kind from d")
def facet_kind(spark: SparkSession, folder: str) -> DataFrame:
    from .filters import cells

    return facets.facet_kind(cells(spark, folder), "cell")


@query("a05_review_counters", "select d.lang, count(*) as n, count(*) filter (l.doc_id is null) as n_unreviewed, count(*) filter (l.quality = 1) as n_accepted, count(*) filter (l.quality = 0) as n_rejected from documents d left join labels l on d.doc_id = l.doc_id group by d.lang")
def counters(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select("doc_id", "lang").join(read(spark, folder, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("n_unreviewed"), F.count_if(F.expr("quality = 1")).alias("n_accepted"), F.count_if(F.expr("quality = 0")).alias("n_rejected"))


@query("a06_job_counters", "select o_custkey, count(*) as n, count(*) filter (o_orderstatus in ('F', 'P')) as n_done from orders group by o_custkey")
def job_counters(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.expr("o_orderstatus in ('F', 'P')")).alias("n_done"))


@query("a07_tied_terciles", """with c as (select l_returnflag as flag, l_linenumber as line, floor(l_quantity / 5) as v, count(*) as c from lineitem group by all),
 m as (select flag, line, v, sum(c) over (partition by flag, line order by v rows unbounded preceding) as cum, row_number() over (partition by flag, line order by v) as i, count(*) over (partition by flag, line) as k, sum(c) over (partition by flag, line) as n from c),
 f as (select flag, line, arg_min(v, abs(3 * cum - n) * 1000 + i) as v, arg_min(i, abs(3 * cum - n) * 1000 + i) as i from m where k >= 3 and i <= k - 2 group by flag, line),
 s as (select m.flag, m.line, arg_min(m.v, abs(3 * cum - 2 * n) * 1000 + m.i) as v from m join f on m.flag = f.flag and m.line = f.line where m.i > f.i and m.i <= k - 1 group by m.flag, m.line),
 b as (select flag, line, cast(any_value(n) as bigint) as n, min(v) as best from m group by flag, line)
 select b.flag, b.line, b.n, coalesce(f.v, best) as first_cut, coalesce(s.v, best) as second_cut from b left join f on b.flag = f.flag and b.line = f.line left join s on b.flag = s.flag and b.line = s.line""")
def terciles(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.floor(F.col("l_quantity") / 5).cast("double").alias("v"))
    return statistics.tied_terciles(rows, ["flag", "line"], "v")


@query("a08_rank_profile", f"select flag, status, case when count(distinct kind) > 1 then 'mixed_types' else coalesce(min(kind), 'none') end as kind, count(kind) as n_ranked, count(*) - count(kind) as n_excluded, count(distinct x) as n_distinct, min(x) as low, max(x) as high from (select flag, status, case when regexp_full_match(raw, '[0-9]+') then 'numeric' end as kind, try_cast(raw as double) as x from ({OBSERVED})) group by flag, status")
def profile(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.rank_profile(observed(spark, folder), KEYS, "raw")


TENTH = f"""with {INTERVALS},
 s as (select flag, status, subject, count(*) as n, count(lo) as m, min(lo) as lo, max(hi) as hi from o group by flag, status, subject having count(lo) > 0),
 t as (select flag, status, subject, case when m < n then -1e300 else lo end as lo, case when m < n then 1e300 else hi end as hi from s),
 c as (select flag, status, subject, lo, hi, bool_or(false) as x from t group by all),
 h as (select c.flag, c.status, c.subject, c.lo, c.hi, coalesce((select bool_or(o.closed) from o where o.flag = c.flag and o.status = c.status and o.subject = c.subject and o.hi = c.hi), false) as closed from c),
 r as (select flag, status, lo, hi, closed, row_number() over (partition by flag, status order by lo) as i, row_number() over (partition by flag, status order by hi, closed) as j from h),
 g as (select flag, status, count(*) as n_subjects, max(case when i = 10 then lo end) as lo, max(case when j = 10 then hi end) as hi, bool_or(j = 10 and closed) as closed from r group by flag, status),
 e as (select *, case when lo > 0 and lo < 1e299 and hi > 0 and hi < 1e299 then floor(log10(lo)) end as a, case when hi > 0 and hi < 1e299 then floor(log10(hi)) - (case when not closed and log10(hi) = floor(log10(hi)) then 1 else 0 end) end as b from g)
 select flag, status, n_subjects, case when n_subjects < 10 then 'insufficient' when a = b then 'ready' else 'ambiguous' end as scale_status, case when n_subjects >= 10 and a = b then cast(a as int) end as decade from e"""


@query("a09_tenth_decade", TENTH)
def tenth(spark: SparkSession, folder: str) -> DataFrame:
    scale = statistics.tenth_decade(observed(spark, folder).withColumnRenamed("status", "line"), ["flag", "line"], "subject", "raw")
    return scale.select("flag", F.col("line").alias("status"), "n_subjects", F.col("status").alias("scale_status"), F.col("decade").cast("int").alias("decade"))


#: In the oracle: every observation with the band that its context's own scale gives it.
BANDED = f"""with scale as ({TENTH}), {INTERVALS},
 d as (select o.*, power(10, s.decade + 1) as t, power(10, s.decade + 2) as u from o left join scale s on s.flag = o.flag and s.status = o.status),
 b as (select subject, flag, status, raw, case when kind = 'missing' or t is null then 'unclassified' when hi < t or (hi = t and not closed) then 'strong' when lo >= t and (hi < u or (hi = u and not closed)) then 'medium' when lo >= u then 'weak' else 'unclassified' end as band from d)"""


def banded(spark: SparkSession, folder: str) -> DataFrame:
    """(flag, status, subject, raw, n, band): the distinct observations against the scale of their context."""
    rows = observed(spark, folder).withColumnRenamed("status", "line")
    rows = statistics.readings(rows, ["flag", "line"], "subject", "raw")
    scale = statistics.tenth_decade(rows, ["flag", "line"], "subject", "raw")
    return statistics.banded(rows, scale, ["flag", "line"], "subject", "raw").withColumnRenamed("line", "status")


@query("a10_bands", f"{BANDED} select subject, flag, status, raw, band, count(*) as n from b group by all")
def bands(spark: SparkSession, folder: str) -> DataFrame:
    return banded(spark, folder).select("subject", *KEYS, "raw", "band", "n")


@query("f27_cell_bands", f"{BANDED} select subject, bool_or(band = 'strong') as any_strong, bool_or(band = 'medium') as any_medium from b group by subject")
def cell_bands(spark: SparkSession, folder: str) -> DataFrame:
    return banded(spark, folder).groupBy("subject").agg(F.coalesce(F.max(F.col("band") == "strong"), F.lit(False)).alias("any_strong"), F.coalesce(F.max(F.col("band") == "medium"), F.lit(False)).alias("any_medium"))


@query("a11_proven_strong", f"with {INTERVALS} select flag, status, count(*) filter (hi < 5 or (hi = 5 and closed)) as n_strong from o where kind <> 'missing' group by flag, status")
def strong(spark: SparkSession, folder: str) -> DataFrame:
    five = F.struct(F.lit(1).alias("sign"), F.lit(0).alias("scale"), F.lit("5").alias("key"))
    rows = N.parsed(observed(spark, folder).groupBy(*KEYS, "raw").agg(F.count("*").alias("n")), "raw").where("v.kind <> 'missing'")
    proven = statistics.proven_strong(F.col("v"), five, True, "lower")
    return rows.groupBy(*KEYS).agg(F.sum(F.when(proven, F.col("n")).otherwise(0)).alias("n_strong"))


@query("a12_assessment", f"with {INTERVALS} select flag, status, subject, count(*) as n, case when count(lo) = 0 then 'missing' when count(lo) < count(*) then 'partial' when count(distinct raw) > 1 then 'conflicting' else min(kind) end as state from o group by flag, status, subject")
def assessment(spark: SparkSession, folder: str) -> DataFrame:
    rows = statistics.assessment(observed(spark, folder).withColumnRenamed("status", "line"), ["flag", "line"], "subject", "raw")
    return rows.select("flag", F.col("line").alias("status"), "subject", "n", "state")


@query("a13_context_comparison", "select a.event_id, case when a.event_type <> b.event_type then 'conflict' when a.user_id % 3 = 0 or b.user_id % 3 = 0 then 'incomplete' else 'complete' end as comparison from events a join events b on b.event_id = a.event_id + 1")
def comparison(spark: SparkSession, folder: str) -> DataFrame:
    conditions = F.map_from_entries(F.filter(F.array(F.struct(F.lit("assay").alias("key"), F.col("event_type").alias("value")), F.when(F.col("user_id") % 3 != 0, F.struct(F.lit("target").alias("key"), F.lit("t").alias("value")))), lambda e: e.isNotNull()))
    rows = read(spark, folder, "events").select("event_id", conditions.alias("c"))
    other = rows.select((F.col("event_id") - 1).alias("event_id"), F.col("c").alias("d"))
    return rows.join(other, "event_id").select("event_id", contexts.compared(F.col("c"), F.col("d"), ["assay", "target"]).alias("comparison"))


HISTOGRAM = f"""with {INTERVALS}, s as (select flag, status, min(lo) as a, max(lo) as b from o where kind = 'scalar' group by 1, 2),
 p as (select o.flag, o.status, subject, raw, kind, case when kind = 'scalar' then 'bin ' || cast(case when a = b then 0 else least(7, cast(floor((lo - a) * 8 / (b - a)) as bigint)) end as string) else kind end as bin from o join s on s.flag = o.flag and s.status = o.status),
 n as (select flag, status, bin, count(*) as n from p group by all),
 m as (select flag, status, bin, count(*) as n from (select flag, status, subject, case when count(*) filter (kind <> 'missing') = 0 then 'missing' when count(distinct raw) = 1 then min(bin) when count(*) filter (kind = 'missing') > 0 then 'partial measurements' else 'conflicting measurements' end as bin from p group by 1, 2, 3) group by all),
 e as (select flag, status, 'bin ' || k as bin from s cross join (select unnest(range(8)) as k) where a <> b or k = 0),
 x as (select flag, status, bin from n union select flag, status, bin from m union select flag, status, bin from e)
 select x.flag, x.status, x.bin, coalesce(n.n, 0) as n_observations, coalesce(m.n, 0) as n_subjects from x left join n using (flag, status, bin) left join m using (flag, status, bin)"""


@query("a14_histogram", HISTOGRAM)
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.histogram(observed(spark, folder), KEYS, "subject", "raw")


@query(
    "a14_strength_histogram",
    f"""with {INTERVALS}, p as (select *, case when kind = 'missing' then kind when hi < 10 or (hi = 10 and raw like '<%') then 'strong' when lo >= 10 and hi < 100 then 'medium' when lo >= 100 then 'weak' else 'unclassified' end as bin from o),
 n as (select flag, status, bin, count(*) as n from p group by all),
 w as (select flag, status, subject, count(*) as k, count(*) filter (kind = 'missing') as absent, min(lo) as lo, max(hi) as hi, bool_or(hi = 10 and closed) as touches from o group by 1, 2, 3),
 m as (select flag, status, case when absent = k then 'missing' when absent > 0 or hi > 1e200 and lo < 10 then 'unclassified' when hi < 10 or (hi = 10 and not touches) then 'strong' when lo >= 10 and hi < 100 then 'medium' when lo >= 100 then 'weak' else 'unclassified' end as bin, count(*) as n from w group by all),
 e as (select distinct flag, status, unnest(['strong', 'medium', 'weak', 'unclassified']) as bin from o),
 x as (select flag, status, bin from n union select flag, status, bin from m union select flag, status, bin from e)
 select x.flag, x.status, x.bin, coalesce(n.n, 0) as n_observations, coalesce(m.n, 0) as n_subjects from x left join n using (flag, status, bin) left join m using (flag, status, bin)""",
)
def strength_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """By a scale of ten and a hundred in every context; a subject counts by the hull of its readings."""
    rows = observed(spark, folder)
    return statistics.histogram(rows, KEYS, "subject", "raw", scale=rows.select(*KEYS, F.lit(0).alias("decade")).distinct())


@query("a15_scaffold_summary", "select case when p_size % 10 = 0 then 'unavailable' else p_brand end as scaffold, count(*) as n_members, count(*) filter (p_retailprice < 1200) as n_strong from part group by 1")
def scaffolds(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "part").withColumn("scaffold", F.when(F.col("p_size") % 10 != 0, F.col("p_brand")))
    return pairs.scaffold_summary(rows.withColumnRenamed("scaffold", "s"), "s", F.col("p_retailprice") < 1200)


@query("a16_region_summary", "select p_brand, count(*) as n_pairs, count(*) filter (abs(rs - cs) <= 5) as n_matched, count(*) filter (abs(rs - cs) > 5) as n_not_matched, count(*) filter (abs(rs - cs) <= 5 and cp < rp) as n_better, count(*) filter (abs(rs - cs) <= 5 and cp > rp) as n_worse, count(*) filter (abs(rs - cs) <= 5 and cp = rp) as n_equal from (select a.p_brand, a.p_size as rs, b.p_size as cs, a.p_retailprice as rp, b.p_retailprice as cp from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey <> b.p_partkey) group by p_brand")
def regions(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    summary = pairs.band_summary(parts, ["p_brand", "p_type"], "id", "size", 5, "price")
    return summary.groupBy("p_brand").agg(*[F.sum(c).alias(c) for c in ("n_pairs", "n_matched", "n_not_matched", "n_better", "n_worse", "n_equal")])


@query("a17_view_regroup", "select p_brand, count(*) as n_members, count(*) filter (p_size < 10) as n_small from part where p_partkey in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 48) group by p_brand")
def regroup(spark: SparkSession, folder: str) -> DataFrame:
    chosen = read(spark, folder, "lineitem").where("l_returnflag = 'R' and l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return pairs.restricted(read(spark, folder, "part"), chosen, "p_partkey").groupBy("p_brand").agg(F.count("*").alias("n_members"), F.count_if(F.expr("p_size < 10")).alias("n_small"))


CORES = ("bolt", "old", "in")


@query("a18_core_membership", " union all ".join(f"select '{c}' as core, count(*) as n, count(*) filter (p_size < 10) as n_strong from part where contains(replace(p_name, ' ', ''), '{c}') or contains(replace(p_name, ' ', ''), '{c[::-1]}')" for c in CORES))
def cores(spark: SparkSession, folder: str) -> DataFrame:
    """Letter chains as confirmed cores; a part has one if it lies anywhere in the chain of its name, in either direction."""
    from .joins import chains

    known = chains(spark, folder)
    chain = lambda c: graphs.Graph(list(c), [{"a": k, "b": k + 1, "kind": "single"} for k in range(len(c) - 1)])
    held = known.select("name", F.explode(F.array(*[F.when(graphs.has_core(chain(c), F.col("atoms"), F.col("bonds")), F.lit(c)) for c in CORES])).alias("core")).where("core is not null")
    parts = read(spark, folder, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("name"), "p_size")
    return parts.join(held, "name").groupBy("core").agg(F.count("*").alias("n"), F.count_if(F.expr("p_size < 10")).alias("n_strong"))


@query("a19_lead_evidence", """with w as (select event_type, user_id, max(value) as v, count(*) filter (value is null) as bad from events group by 1, 2 having count(*) filter (value is null) = 0),
 r as (select event_type, user_id, rank() over (partition by event_type order by v desc) - 1 as worse, count(*) over (partition by event_type, v) as ties, count(*) over (partition by event_type) as n from w)
 select user_id, round(avg(100 * case when n = 1 then 0.5 else (worse + (ties - 1) / 2.0) / (n - 1) end), 6) as potency, count(*) as ranked, round(count(*) * 1.0e0 / (select count(distinct event_type) from w), 6) as coverage from r group by user_id""")
def lead(spark: SparkSession, folder: str) -> DataFrame:
    rows = statistics.lead_evidence(read(spark, folder, "events"), ["event_type"], "user_id", "value")
    return rows.select("user_id", F.round("potency", 6).alias("potency"), "ranked", F.round("coverage", 6).alias("coverage"))


@query("a20_quality_score", "select p_partkey, round(0.35e0 * p_size + 0.2e0 * (p_size % 7) + 0.2e0 * p_retailprice / 100 + 0.15e0 * (p_partkey % 100) + 0.1e0 * 50, 6) as quality from part")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    parts = {"potency": F.col("p_size"), "coverage": F.col("p_size") % 7, "admet": F.col("p_retailprice") / 100, "physchem": F.col("p_partkey") % 100, "evidence": F.lit(50)}
    return read(spark, folder, "part").select("p_partkey", F.round(scores.quality(parts), 6).alias("quality"))


@query("a21_safety_score", "select l_orderkey, l_linenumber, round(100 * (0.6e0 * (0.5e0 * ((1 - l_discount) + (1 - l_tax)) / 2 + 0.5e0 * least(1 - l_discount, 1 - l_tax)) + 0.2e0 * l_quantity / 50 + 0.2e0 * (1 - l_tax)), 6) as score from lineitem")
def safety(spark: SparkSession, folder: str) -> DataFrame:
    score = scores.safety([F.col("l_discount"), F.col("l_tax")], [F.col("l_quantity") / 50], [F.col("l_tax")])
    return read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


SOFT = {"molecular_weight": "p_retailprice", "logP": "p_size / 5e0", "tpsa": "p_size * 5e0", "hydrogen_bond_donors": "p_size % 13 * 1e0", "hydrogen_bond_acceptors": "p_size % 29 * 1e0", "solubility": "-(p_size % 11) * 1e0"}
SOFT_SQL = " + ".join(f"{w} * 100 * greatest(0, 1 - greatest({low} - ({SOFT[k]}), ({SOFT[k]}) - {high}, 0) / {decay}e0)" for k, (w, low, high, decay) in scores.BANDS.items())


@query("a22_desirability", f"select p_partkey, round({SOFT_SQL}, 6) as score from part")
def desirability(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select("p_partkey", F.round(scores.desirability({k: F.expr(e) for k, e in SOFT.items()}), 6).alias("score"))


@query("a23_confidence", "select p_partkey, round(s, 6) as score, case when s >= 0.7 then 'high' when s >= 0.4 then 'medium' else 'low' end as level, round(j, 6) as overlap from (select p_partkey, 0.35e0 * (p_size / 50e0) + 0.45e0 * (p_retailprice / 2500) + 0.2e0 * (p_partkey % 2) as s, len(list_intersect(list_distinct(string_split(p_brand, '')), list_distinct(string_split(p_name, '')))) * 1e0 / len(list_distinct(string_split(p_brand, '') || string_split(p_name, ''))) as j from part)")
def confidence(spark: SparkSession, folder: str) -> DataFrame:
    score, level = scores.confidence((F.col("p_size") / 50, F.col("p_retailprice") / 2500, (F.col("p_partkey") % 2).cast("double")))
    overlap = scores.character_overlap(F.col("p_brand"), F.col("p_name"))
    return read(spark, folder, "part").select("p_partkey", F.round(score, 6).alias("score"), level.alias("level"), F.round(overlap, 6).alias("overlap"))


@query(
    "a23_consensus",
    """with e as (select p_partkey, case p_size % 5 when 0 then [] when 1 then [p_brand] when 2 then [p_brand, null] when 3 then [p_brand, p_brand, p_type] else [p_brand, p_type, p_name, 'x'] end as s from part),
 k as (select p_partkey, len(s) as n, list_filter(s, lambda x: x is not null and length(x) >= 3) as o from e),
 u as (select p_partkey, i, o[i] as v from (select p_partkey, o, unnest(range(1, len(o) + 1)) as i from k)),
 m as (select p_partkey, max(c) as most from (select p_partkey, v, count(*) as c from u group by 1, 2) group by 1),
 j as (select a.p_partkey, avg(len(list_intersect(list_distinct(string_split(a.v, '')), list_distinct(string_split(b.v, '')))) * 1e0 / len(list_distinct(string_split(a.v, '') || string_split(b.v, '')))) as j from u a join u b on a.p_partkey = b.p_partkey and a.i < b.i group by 1)
 select p_partkey, round(case when n <= 1 then 0.5e0 when len(o) <= 1 then 0.3e0 else 0.6e0 * most / len(o) + 0.4e0 * j end, 6) as consensus from k left join m using (p_partkey) left join j using (p_partkey)""",
)
def consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Up to four readings of a part, some missing or too short."""
    none = F.lit(None).cast("string")
    read_ = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 5 == 1, F.array("p_brand")).when(F.col("p_size") % 5 == 2, F.array(F.col("p_brand"), none)).when(F.col("p_size") % 5 == 3, F.array("p_brand", "p_brand", "p_type")).otherwise(F.array(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.lit("x")))
    return read(spark, folder, "part").select("p_partkey", F.round(scores.engine_consensus(read_), 6).alias("consensus"))


@query("a24_dominant_prefix", "select lang, case when n > 0 then name else 'Cpd-' end as prefix, n as hits from (select lang, greatest(a, b, c) as n, case when a >= b and a >= c then 'Example' when b >= c then 'Compound' else 'Intermediate' end as name from (select lang, cast(sum(len(regexp_extract_all(text, '(?i)Example[-\\s]+(\\d+)'))) as bigint) as a, cast(sum(len(regexp_extract_all(text, '(?i)Compound[-\\s]+(\\d+)'))) as bigint) as b, cast(sum(len(regexp_extract_all(text, '(?i)Intermediate\\s+(\\d+)'))) as bigint) as c from documents group by lang))")
def prefix(spark: SparkSession, folder: str) -> DataFrame:
    return pages.dominant_prefix(read(spark, folder, "documents"), "lang", "text")


@query("a25_row_merge", """with o as (select l_orderkey as doc, l_suppkey as cpd, l_linenumber as page, l_returnflag as k, cast(l_quantity as varchar) as v from lineitem),
 s as (select *, row_number() over (partition by doc, cpd, k order by page, v) as slot from o)
 select doc, cpd, cast(min(page) as bigint) as ordinal, string_agg(k || '=' || v, '|' order by k) as fields from s group by doc, cpd, slot""")
def row_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("cpd"), F.col("l_linenumber").alias("page"), F.col("l_linenumber").cast("long").alias("ordinal"), F.create_map("l_returnflag", F.col("l_quantity").cast("string")).alias("fields"))
    merged = merging.merged_rows(rows, "doc", "cpd", "page", "ordinal", "fields")
    return merged.select("doc", "cpd", "ordinal", F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["key"], f["value"])), "|").alias("fields"))


@query("a26_identical_merge", "select c_nationkey as label, count(*) as n_rows, count(distinct c_mktsegment) as n_chemistry, case when count(distinct c_acctbal > 0) = 1 then min(c_acctbal > 0) end as positive, count(distinct c_acctbal > 0) > 1 as positive_conflict, case when count(distinct c_mktsegment) > 1 then 'identifier_conflict' else 'merged' end as status from customer group by 1")
def identical(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "customer").select(F.col("c_nationkey").alias("label"), F.col("c_mktsegment").alias("chemistry"), (F.col("c_acctbal") > 0).alias("positive"))
    return merging.identical_merge(rows, "label", "chemistry", ["positive"])


@query("a27_direction_consensus", "select l_suppkey, case when count(distinct l_returnflag) = 1 then min(l_returnflag) else 'mixed_contexts' end as l_returnflag from lineitem where l_quantity > 49 group by 1")
def consensus(spark: SparkSession, folder: str) -> DataFrame:
    return merging.consensus(read(spark, folder, "lineitem").where("l_quantity > 49"), ["l_suppkey"], "l_returnflag", "mixed_contexts")


@query("a28_quality_counters", "select count(*) as n_rows, count(distinct o_custkey) as n_labels, count(*) filter (o_orderstatus = 'F') as n_confirmed, count(*) filter (o_orderstatus <> 'F') as n_review from orders")
def qa(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").withColumn("state", F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("review"))
    return checks.quality_counters(rows, "o_custkey", "state")


@query("a29_inventory_gaps", "select o_orderkey, cast(o_orderkey % 7 as bigint) as n_declared, count(l_orderkey) as n_observed from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey having o_orderkey % 7 <> count(l_orderkey)")
def inventory(spark: SparkSession, folder: str) -> DataFrame:
    declared = read(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("n"))
    seen = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return checks.inventory_gaps(declared, seen.join(declared.select("o_orderkey"), "o_orderkey", "left_semi"), ["o_orderkey"], "n")


@query("a30_conservation", "select flag, n_parts, n_whole from (select 'x' as flag, cast(0 as bigint) as n_parts, cast(0 as bigint) as n_whole) where false")
def conservation(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram subjects must add up to the context's subjects: no row comes back."""
    rows = observed(spark, folder).withColumn("flag", F.concat("flag", "status"))
    bins = statistics.histogram(rows, ["flag"], "subject", "raw")
    totals = rows.groupBy("flag").agg(F.count_distinct("subject").alias("n"))
    return checks.unreconciled(bins, totals, ["flag"], "n_subjects", "n")


@query("a31_accuracy", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as n_confirmed, count(*) filter (o_orderstatus <> 'F') as n_review from orders group by 1")
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count_if(F.expr("o_orderstatus = 'F'")).alias("n_confirmed"), F.count_if(F.expr("o_orderstatus <> 'F'")).alias("n_review"))


@query("a32_cache_budget", "select event_id from (select event_id, sum(length(props)) over w as b, count(*) over w as n from events window w as (partition by user_id order by ts desc, event_id rows unbounded preceding)) where b <= 100 and n <= 5")
def cache_budget(spark: SparkSession, folder: str) -> DataFrame:
    entries = read(spark, folder, "events").withColumn("size", F.length("props"))
    return checks.kept_by_budget(entries, "user_id", "size", "ts", "event_id", 100, 5).select("event_id")


def fingerprint_sql(rows: str, key: str) -> str:
    """Common table expressions from rows (key, j: a row as JSON) to w (key, n, fingerprint)."""
    return f"""d as (select {key}, sha256(j) as d, count(*) as n from ({rows}) group by all),
 q as (select {key}, d[1:3] as p, cast(sum(n) as bigint) as n, sha256(string_agg(d || ':' || n, ',' order by d || ':' || n)) as d from d group by all),
 w as (select {key}, cast(sum(n) as bigint) as n, sha256(string_agg(p || ':' || d, ',' order by p)) as fingerprint from q group by {key})"""


CUSTOMER_ROW = """select c_nationkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_acctbal":' || c_acctbal || '}' as j from customer"""


@query("a33_fingerprint", f"with {fingerprint_sql(CUSTOMER_ROW, 'c_nationkey')} select c_nationkey, n, fingerprint from w")
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """One digest for each nation's customers; equal tables have equal digests in any row order."""
    return tables.fingerprint(read(spark, folder, "customer"), ["c_nationkey"], ["c_custkey", "c_name", "c_acctbal"])


@query("a_percentile_windows", "select c_custkey, round(case when n = 1 then 0.5 else (worse + (ties - 1) / 2.0) / (n - 1) end, 6) as percentile from (select c_custkey, rank() over (partition by c_nationkey order by c_acctbal) - 1 as worse, count(*) over (partition by c_nationkey, c_acctbal) as ties, count(*) over (partition by c_nationkey) as n from customer)")
def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = statistics.midrank(read(spark, folder, "customer"), ["c_nationkey"], "c_acctbal", better="high")
    return rows.select("c_custkey", F.round("percentile", 6).alias("percentile"))


def uncovered_pages(spark: SparkSession, folder: str) -> DataFrame:
    wanted = read(spark, folder, "orders").select(F.col("o_orderkey").alias("page"))
    found = read(spark, folder, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("page")).agg(F.lit("parsed").alias("status"))
    return checks.uncovered(wanted, found, ["page"], "status")


query("a_coverage_gaps", "select o_orderkey as page, 'unresolved/no_supported_activity_table' as status from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")(uncovered_pages)
