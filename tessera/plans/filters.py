"""F queries: filters over multi-valued cells of parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identifiers import identifier_key, label, same_identifier
from tessera.functions.rules import page_signals
from tessera.operators import eligibility, results
from tessera.operators.filters import Filter, draft, matching, replaced, search
from tessera.operators.overlays import corrected, effective
from tessera.operators.study import Study

from .registry import CELL, PRINTED, RAW, observed, query, read

COLUMNS = {"cell": "text", "printed": "identifier"}


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of each part, in the order of its lines."""
    lines = read(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber", F.expr(CELL).alias("v")).alias("c"))
    return lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["v"]).alias("cell"))


def cell_query(name: str, f: Filter, having: str) -> None:
    sql = f"with c as (select l_partkey as id, {CELL} as v from lineitem) select id from c group by id having {having}"
    query(name, sql)(lambda spark, folder: matching(cells(spark, folder), [f], COLUMNS).select("id"))


NUMERIC = "(case when v <> '' and regexp_full_match(v, '[0-9]+') then cast(v as double) end)"
cell_query("f01_empty", Filter("cell", "empty"), "count(*) filter (v <> '') = 0")
cell_query("f01_not_empty", Filter("cell", "not_empty"), "count(*) filter (v <> '') > 0")
cell_query("f03_in", Filter("cell", "in", values=("12", "A")), "count(*) filter (v in ('12', 'A')) > 0")
cell_query("f03_not_in", Filter("cell", "not_in", values=("12", "A", "+++")), "count(*) filter (v in ('12', 'A', '+++')) = 0")
cell_query("f03_in_or_empty", Filter("cell", "in", values=("7",), include_empty=True), "count(*) filter (v = '7') > 0 or count(*) filter (v <> '') = 0")
cell_query("f05_contains", Filter("cell", "contains", ">4"), "count(*) filter (v like '%>4%') > 0")
cell_query("f06_not_contains", Filter("cell", "not_contains", "a"), "count(*) filter (lower(v) like '%a%') = 0")
cell_query("f07_starts_with", Filter("cell", "starts_with", "1"), "count(*) filter (v like '1%') > 0")
cell_query("f07_ends_with", Filter("cell", "ends_with", "9"), "count(*) filter (v like '%9') > 0")
cell_query("f08_eq", Filter("cell", "eq", "12.0"), f"count(*) filter ({NUMERIC} = 12) > 0")
cell_query("f09_ne", Filter("cell", "ne", "a"), "count(*) filter (v = 'A') = 0")
cell_query("f10_gt", Filter("cell", "gt", 43), f"count(*) filter ({NUMERIC} > 43) > 0")
cell_query("f10_gte", Filter("cell", "gte", "44"), f"count(*) filter ({NUMERIC} >= 44) > 0")
cell_query("f10_lt", Filter("cell", "lt", 3), f"count(*) filter ({NUMERIC} < 3) > 0")
cell_query("f10_lte_plus", Filter("cell", "lte", "++++"), "count(*) filter (v = '+++') > 0")

BANDED = f"select l_partkey as id, case when l_quantity < 10 then 'strong' when l_quantity < 20 then 'medium' else 'none' end as b, {CELL} as v from lineitem"


@query("f02_band", f"with c as ({BANDED}) select id from c group by id having count(*) filter (b = 'medium') > 0")
def band(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").selectExpr("l_partkey as id", "case when l_quantity < 10 then 'strong' when l_quantity < 20 then 'medium' else 'none' end as b", f"{CELL} as v")
    table = lines.groupBy("id").agg(F.collect_list("v").alias("cell"), F.collect_set("b").alias("bands"))
    return matching(table, [Filter("cell", "band", "medium")], {"cell": "band"}, {"cell": F.col("bands")}).select("id")


@query("f04_identifier_in", f"select p_partkey as id from part where p_size % 4 in (0, 3) and p_partkey in (8, 12, 15) or upper({PRINTED}) in ('CPD-9A', 'CPD-5A')")
def identifier_in(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.array(F.expr(PRINTED)).alias("printed"))
    return matching(parts, [Filter("printed", "in", values=("8", "Compound 12", "compound 15", "Cpd-9a", "CPD-5A"))], COLUMNS).select("id")


@query("f11_search", "select p_partkey as id from part where contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'steel')")
def free_text(spark: SparkSession, folder: str) -> DataFrame:
    return search(read(spark, folder, "part"), "STEEL", ["p_name", "p_brand", "p_type"]).select(F.col("p_partkey").alias("id"))


@query("f12_review_state", "select d.doc_id, case when l.doc_id is null then 'unreviewed' when l.quality = 1 then 'accepted' else 'rejected' end as review from documents d left join labels l on d.doc_id = l.doc_id where l.doc_id is null or l.quality = 0")
def review_state(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents").select("doc_id"), read(spark, folder, "labels")
    state = F.when(F.col("quality").isNull(), "unreviewed").when(F.col("quality") == 1, "accepted").otherwise("rejected")
    return docs.join(labels, "doc_id", "left").select("doc_id", state.alias("review")).where("review <> 'accepted'")


@query("f13_checked_two_filters", f"with c as (select l_partkey as id, {CELL} as v from lineitem) select id from c group by id having count(*) filter (v like '%>4%') > 0 and count(*) filter ({NUMERIC} < 5) > 0")
def two_filters(spark: SparkSession, folder: str) -> DataFrame:
    return matching(cells(spark, folder), [Filter("cell", "contains", ">4"), Filter("cell", "lt", "5")], COLUMNS).select("id")


#: Labels of parts, with intermediates, missing numbers and temporary names among them.
LABEL = "case p_partkey % 12 when 0 then concat('Intermediate ', cast(p_size as string)) when 1 then concat('intermediates_', cast(p_size as string)) when 2 then '中间体3' when 3 then 'Intermediately named' when 4 then ' N/A' when 5 then '  ' when 6 then concat('source-structure:', cast(p_size as string)) when 7 then concat('I-', cast(p_size as string)) when 8 then concat('interm. ', cast(p_size as string)) when 9 then concat('关联结构 a1b2c', cast(p_size % 10 as string)) else concat('Compound ', cast(p_size as string)) end"
RECORD = f"""p_partkey as id, {LABEL} as label, {PRINTED} as printed, case when p_partkey % 10 = 0 then 'source-structure:7' else cast(p_partkey as string) end as record, case when p_size % 9 <> 0 then p_name end as structure, case when p_size % 8 = 0 then 'activity_only' else 'compound' end as kind,
 case when p_size % 7 = 0 then 'ambiguous_binding' when p_size % 7 = 1 then 'missing_or_invalid_identifier' else 'low_resolution' end as flag, case p_size % 13 when 0 then 'Intermediates' when 1 then 'source-structure:9' end as origin, case p_size % 3 when 0 then 'high' when 1 then 'high' else 'low' end as confidence, p_size * 1000 as page,
 case p_partkey % 6 when 0 then 'rejected' when 1 then 'accepted' end as review, p_partkey % 7 = 0 as stale, case when p_partkey % 11 = 0 then 'failed' else 'valid' end as recognition, case p_partkey % 3 when 0 then 'ok' when 1 then 'manual_correction' else 'blurred' end as quality"""
INTERMEDIATE_SQL = "regexp_matches(trim(coalesce({}, '')), '(?i)^(intermediates?($|[\\s_:.：\\-－0-9０-９])|interm[.\\s_]|中间体|中間体|中間體)')"
UNCONFIRMED_SQL = "(trim(label) = '' or lower(trim(label)) = 'n/a' or regexp_matches(trim(label), '(?i)^(source-structure:|关联结构\\s+[a-f0-9]{6})') or coalesce(origin, '') like 'source-structure:%' or flag = 'missing_or_invalid_identifier')"


def records(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").selectExpr(*split_columns(RECORD))


def split_columns(text: str) -> list[str]:
    """Select items of an SQL text, split at commas outside of brackets."""
    items, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            items.append("")
        else:
            items[-1] += c
    return items


@query("f14_numbered_product", f"with r as (select {RECORD} from part) select id from r where structure is not null and kind <> 'activity_only' and record not like 'source-structure:%' and flag <> 'ambiguous_binding' and not {INTERMEDIATE_SQL.format('label')} and not {INTERMEDIATE_SQL.format('printed')}")
def numbered_product(spark: SparkSession, folder: str) -> DataFrame:
    test = eligibility.numbered_product(F.col("record"), F.col("structure"), F.col("kind"), F.array("flag"), F.col("label"), F.col("record"), F.col("printed"))
    return records(spark, folder).where(test).select("id")


@query("f15_source_exclusion", f"with r as (select {RECORD} from part) select id, case when {UNCONFIRMED_SQL} then 'unconfirmed_identifier' when {INTERMEDIATE_SQL.format('label')} or {INTERMEDIATE_SQL.format('origin')} then 'intermediate' end as exclusion from r")
def exclusion(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("id", eligibility.source_exclusion(F.col("label"), F.col("origin"), F.array("flag")).alias("exclusion"))


@query("f16_first_refusal", f"""with r as (select {RECORD} from part) select id, case when record like 'source-structure:%' or confidence <> 'high' or structure is null or page > 20000 or page < 1 or flag = 'ambiguous_binding' then 'ownership_unproved'
 when review = 'rejected' then 'review' when stale then 'stale_correction' when recognition <> 'valid' or quality = 'blurred' then 'recognition' when id % 17 = 0 then 'graph' end as reason from r""")
def first_refusal(spark: SparkSession, folder: str) -> DataFrame:
    own = {c: F.col(c) for c in ("confidence", "structure", "page", "review", "stale", "recognition", "quality")}
    reason = eligibility.lead_refusal(own | {"id": F.col("record"), "image": F.col("structure"), "flags": F.array("flag"), "graph": F.col("id") % 17 != 0})
    return records(spark, folder).select("id", reason.alias("reason"))


@query("f17_row_scope", """with f as (select p_partkey as id, p_size < 25 as strong, p_partkey % 5 = 0 as lead, p_partkey <> min(p_partkey) over w and p_type <> first_value(p_type) over w as changed from part where p_size % 10 = 3 window w as (partition by p_size % 10 order by p_partkey rows between unbounded preceding and unbounded following))
 select 'all' as scope, id from f union all select 'strong', id from f where strong union all select 'leads', id from f where lead union all select 'changes', id from f where changed union all select 'strong_changes', id from f where changed and strong""")
def row_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Each scope of one region: parts of a size are a region, types are fragments, and a region's first part is its reference."""
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("molecule"), "p_type", (F.col("p_size") % 10).alias("region"), (F.col("p_size") < 25).alias("strong"), F.when(F.col("p_partkey") % 5 == 0, "selected").otherwise("none").alias("candidate_status"))
    first = parts.groupBy("region").agg(F.min("molecule").alias("reference"), F.min_by("p_type", "molecule").alias("own"))
    fragments = parts.join(first, "region").select("region", "reference", F.col("p_type").alias("fragment"), (F.col("p_type") == F.col("own")).alias("is_reference"), "molecule")
    views = [eligibility.in_scope(parts, scope, fragments=fragments, region=3).select(F.lit(scope).alias("scope"), F.col("molecule").alias("id")) for scope in eligibility.SCOPES]
    return reduce(DataFrame.unionByName, views)


PAGE = "left(text, 2400)"


@query("f18_page_signals", f"""select doc_id, regexp_matches({PAGE}, '(?i)(^|[^A-Za-z])(ki|kd)\\b|ic50|dc50|ec50|dmax|gi50|cc50|抑制率|结合率|降解率|表\\s*\\d|table\\s+\\d.*activit') or regexp_matches({PAGE}, '(^|[^A-Za-z])[nµμu]M($|[^A-Za-z])')
    or (len(regexp_extract_all({PAGE}, '(?i)Cpd[-\\s]?\\d+|实施例\\s*\\d+')) >= 10 and len(regexp_extract_all({PAGE}, '\\b\\d{{1,5}}\\b')) >= 2 * len(regexp_extract_all({PAGE}, '(?i)Cpd[-\\s]?\\d+|实施例\\s*\\d+'))) as activity,
    regexp_matches({PAGE}, '(?im)权利要求|权利要求书|^What is claimed|BACKGROUND|SUMMARY|DRAWING|检索报告|PCT/ISA') or regexp_matches({PAGE}, '(?i)生物测试|测试例\\s*\\d+|Test\\s*Example') as stops from documents""")
def signals(spark: SparkSession, folder: str) -> DataFrame:
    found = page_signals(F.col("text"))
    return read(spark, folder, "documents").select("doc_id", found["activity"].alias("activity"), found["stops"].alias("stops"))


@query("f19_intermediate_label", f"with r as (select {RECORD} from part) select id from r where {INTERMEDIATE_SQL.format('label')} or {INTERMEDIATE_SQL.format('origin')}")
def intermediate(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).where(eligibility.is_intermediate(F.col("printed"), F.col("record"), F.col("label"), F.col("origin"))).select("id")


@query("f20_escaped_search", "select p_partkey as id from part where contains(p_brand, '#1')")
def escaped(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").where(F.contains("p_brand", F.lit("#1"))).select(F.col("p_partkey").alias("id"))


@query("f21_effective_property", "select p_partkey as id, case when p_size % 5 = 0 then case when p_size % 2 = 0 then cast(null as double) else 1.0 end else coalesce(case when p_size % 3 = 0 then p_retailprice end, cast(p_size as double)) end as value from part")
def effective_property(spark: SparkSession, folder: str) -> DataFrame:
    key = F.lit("x")
    manual = F.when(F.col("p_size") % 5 == 0, F.create_map(key, F.when(F.col("p_size") % 2 != 0, 1.0))).otherwise(F.create_map().cast("map<string,double>"))
    computed = F.when(F.col("p_size") % 3 == 0, F.create_map(key, "p_retailprice"))
    model = F.create_map(key, F.col("p_size").cast("double"))
    return read(spark, folder, "part").select(F.col("p_partkey").alias("id"), effective(manual, computed, model, "x").alias("value"))


@query("f22_corrections", "select p_partkey, case when p_partkey % 10 = 0 then 'fixed' else p_brand end as p_brand, case when p_partkey % 10 = 0 then 'applied' when p_partkey % 10 = 1 then 'stale' else 'none' end as correction from part")
def corrections(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    basis = F.sha2("p_name", 256)
    edits = parts.where("p_partkey % 10 < 2").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, basis).otherwise("old").alias("basis"), F.lit("fixed").alias("p_brand"))
    return corrected(parts, edits, ["p_partkey"], ["p_brand"], basis).select("p_partkey", "p_brand", "correction")


@query("f23_export_roles", "select p_partkey, p_brand as lead_group, p_retailprice as lead_price, cast(p_size as bigint) as descriptor_size from part")
def export_roles(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("lead_group"), F.col("p_retailprice").alias("lead_price"), F.col("p_size").cast("long").alias("descriptor_size"))


@query("f24_labels", f"select p_partkey, case when p_size % 4 = 1 then concat(cast(p_partkey as string), 'A') when p_size % 4 = 2 then concat('I-', cast(p_size as string), '-', cast(p_partkey as string)) else cast(p_partkey as string) end as label from part")
def labels(spark: SparkSession, folder: str) -> DataFrame:
    printed = F.expr(PRINTED)
    return read(spark, folder, "part").select("p_partkey", label(printed, printed, F.lit(None).cast("string")).alias("label"))


@query("f25_draft_filters", f"with c as (select l_partkey as id, {CELL} as v from lineitem) select id from c group by id having count(*) filter ({NUMERIC} >= 44) > 0")
def drafts(spark: SparkSession, folder: str) -> DataFrame:
    filters = replaced([draft("text", "cell", "contains", "x")], draft("number", "cell", "gte", "44"), "cell")
    return matching(cells(spark, folder), filters, COLUMNS).select("id")


CELLS = f"c as (select l_partkey as id, l_orderkey as o, l_linenumber as l, {CELL} as v from lineitem), g as (select id, nullif(first(v order by o, l, v), '') as least, count(*) filter (v like '%>4%') as n_over, count(*) filter ({NUMERIC} < 20) as n_low from c group by id)"
CHOICE = "case when v = 'A' then 1 when regexp_full_match(v, '[0-9]+') then 2 when v = '+++' then 3 else 4 end"
PLACED = "case when regexp_full_match(least, '[0-9]+') then 2 when least = 'A' then 1 when least = '+++' then 3 else 4 end"


@query("q_results_page", f"with {CELLS} select id, row_number() over (order by least is null, {PLACED}, try_cast(least as double), least, id) - 41 as place from g where n_over > 0 and n_low > 0 and cast(id as varchar) like '%1%' qualify place between 0 and 39")
def results_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of forty of a searched, filtered and sorted table; places show its order."""
    request = results.Request("1", (Filter("cell", "contains", ">4"), Filter("cell", "lt", "20")), "cell", page=2, size=40)
    asked = results.Results(cells(spark, folder), {"cell": "text"}, ("id",), ("id",))
    page = asked.page(request).select("id", F.monotonically_increasing_id().alias("place"))
    return page


@query("q_results_choices", f"with c as (select l_partkey as id, {CELL} as v from lineitem), d as (select distinct id, v from c where v <> '' and cast(id as varchar) like '%1%') select v as value, count(*) as n from d group by v order by {CHOICE}, try_cast(v as double), v limit 20")
def results_choices(spark: SparkSession, folder: str) -> DataFrame:
    request = results.Request("1", (Filter("cell", "contains", ">4"),), size=40)
    asked = results.Results(cells(spark, folder), {"cell": "text"}, ("id",), ("id",))
    return asked.choices(request, "cell", size=20)


@query("q_study_rows", f"with o as (select l_partkey as id, {RAW} as raw from lineitem where l_returnflag = 'R'), k as (select id, case when count(distinct raw) = 1 then try_cast(min(raw) as double) end as v from o group by id) select p_partkey as molecule, row_number() over (order by v is null, v desc, p_partkey) as place from part left join k on id = p_partkey where p_size > 25 qualify place <= 200")
def study_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of the strong members of a study, by one context, the highest agreed value first; places show the order."""
    members = read(spark, folder, "part").select(F.col("p_partkey").alias("molecule"), F.concat(F.lit("I-"), F.col("p_partkey").cast("string")).alias("label"), (F.col("p_size") > 25).alias("strong"), F.lit("selected").alias("candidate_status"))
    seen = observed(spark, folder).select(F.col("subject").alias("molecule"), F.col("flag").alias("context"), "raw")
    page = Study(members, seen).rows("context:R", descending=True, size=200, scope="strong")
    return page.select("molecule", (F.monotonically_increasing_id() + 1).alias("place"))


@query("f26_checklist_except", f"with c as (select l_partkey as id, {CELL} as v from lineitem) select id from c group by id having count(*) filter (v in ('A', '>45')) = 0")
def checklist(spark: SparkSession, folder: str) -> DataFrame:
    return matching(cells(spark, folder), [draft("text", "cell", "choices", chosen=("A", ">45"), all_but=True)], COLUMNS).select("id")


@query("f04_same_identifier", f"select a.p_partkey as id from part a where a.p_size % 4 in (0, 3)")
def alias_pairs(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.expr(PRINTED).alias("printed"))
    return parts.where(same_identifier(F.col("printed"), F.concat(F.lit("Cmpd. "), F.col("id").cast("string"))) & (identifier_key(F.col("printed")) != "")).select("id")
