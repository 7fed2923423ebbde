"""N queries: values, units, identifiers, rules, headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import contexts, headers, identifiers, rules, text
from tessera.functions import numbers as N
from tessera.operators import text_tables

from .registry import CELL, OBSERVED, PRINTED, RAW, observed, query, read


@query("n01_literals", f"select raw, case when raw = 'ND' then 'missing' when raw like '[%' or raw like '>%' or raw like '<%' then 'interval' else 'scalar' end as kind, case when raw = 'ND' then null when raw like '<%' then cast('-inf' as double) when raw like '>%' then cast(substr(raw, 2) as double) when raw like '[%' then cast(string_split(trim(raw, '[]'), ',')[1] as double) else cast(raw as double) end as low, case when raw = 'ND' then null when raw like '>%' then cast('inf' as double) when raw like '<%' then cast(substr(raw, 2) as double) when raw like '[%' then cast(string_split(trim(raw, '[]'), ',')[2] as double) else cast(raw as double) end as high, count(*) as n from ({OBSERVED}) group by raw")
def literals(spark: SparkSession, folder: str) -> DataFrame:
    rows = observed(spark, folder).groupBy("raw").agg(F.count("*").alias("n"))
    value = N.parse(F.col("raw"))
    return rows.select("raw", value["kind"].alias("kind"), N.approximate(value["low"]).alias("low"), N.approximate(value["high"]).alias("high"), "n")


@query("n02_missing_tokens", f"select v, v in ('', 'ND') as missing, v = 'ND' as missing_token from (select {CELL} as v from lineitem union select {RAW} from lineitem)")
def missing(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem")
    rows = lines.select(F.expr(CELL).alias("v")).union(lines.select(F.expr(RAW))).distinct()
    return rows.select("v", N.is_missing(F.col("v")).alias("missing"), N.is_missing_token(F.col("v")).alias("missing_token"))


@query("n03_grades", f"select v, case when v = '' then 'missing' when v in ('A', '+++') then 'ordinal' when v like '>%' then 'interval' else 'scalar' end as kind, count(*) as n from (select {CELL} as v from lineitem) group by v")
def grades(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select(F.expr(CELL).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return rows.select("v", N.parse(F.col("v"), ["A", "B", "+++"])["kind"].alias("kind"), "n")


UNITS = "case l_linenumber when 1 then 'nM' when 2 then 'uM' when 3 then 'mM' when 4 then '%' when 5 then '' else 'mg' end"


@query("n04_inline_units", f"select l_orderkey, l_linenumber, case l_linenumber when 1 then l_quantity when 2 then l_quantity * 1000 when 3 then l_quantity * 1000000 when 4 then null when 5 then l_quantity end as nanomolar from lineitem")
def units(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.col("l_quantity").cast("long").cast("string"), F.expr(f"case when l_linenumber = 5 then '' else concat(' ', {UNITS}) end"))
    rows = N.parsed(read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("cell")), "cell", read=lambda text: N.let(N.inline(text, F.lit("nM")), lambda v: N.approximate(v["low"])))
    return rows.select("l_orderkey", "l_linenumber", F.col("v").alias("nanomolar"))


@query("n06_unit_basis", f"select distinct u, case u when 'nM' then 'molar' when 'uM' then 'molar' when 'mM' then 'molar' when '%' then 'percent' end as family, case u when 'nM' then -9 when 'uM' then -6 when 'mM' then -3 when '%' then 0 end as power from (select {UNITS} as u from lineitem)")
def basis(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select(F.expr(UNITS).alias("u")).distinct()
    unit = N.unit_of(F.col("u"))
    return rows.select("u", unit["family"].alias("family"), unit["power"].alias("power"))


@query("n07_comparisons", f"""with i as (select distinct raw, case when raw like '<%' then -1e300 when raw like '>%' then cast(substr(raw, 2) as double) when raw like '[%' then cast(string_split(trim(raw, '[]'), ',')[1] as double) else try_cast(raw as double) end as lo, case when raw like '>%' then 1e300 when raw like '<%' then cast(substr(raw, 2) as double) when raw like '[%' then cast(string_split(trim(raw, '[]'), ',')[2] as double) else try_cast(raw as double) end as hi, raw not like '<%' as uc, raw not like '>%' as lc, regexp_full_match(raw, '[0-9]+') as scalar from ({OBSERVED}) where raw <> 'ND')
 select a.raw as reference, b.raw as candidate, case when a.scalar and b.scalar and a.lo = b.lo then 'equal' when b.hi < a.lo or (b.hi = a.lo and not (b.uc and a.lc)) then 'better' when a.hi < b.lo or (a.hi = b.lo and not (a.uc and b.lc)) then 'worse' else 'indeterminate' end as outcome from i a, i b""")
def comparisons(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct source string against every other: a grid of a few dozen values by construction."""
    values = observed(spark, folder).where("raw <> 'ND'").select("raw").distinct().select("raw", N.parse(F.col("raw")).alias("v"))
    grid = values.agg(F.collect_list(F.struct("raw", "v")).alias("all"))
    rows = grid.select(F.explode("all").alias("r"), "all").select("r", F.explode("all").alias("c"))
    return rows.select(F.col("r.raw").alias("reference"), F.col("c.raw").alias("candidate"), N.compare(F.col("r.v"), F.col("c.v"), "lower").alias("outcome"))


@query("n08_fold_change", "select a.l_orderkey, round(a.l_quantity / b.l_quantity, 9) as fold from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber = 2")
def folds(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a, b = (lines.where(f"l_linenumber = {k}").select("l_orderkey", F.col("l_quantity").cast("string").alias(f"q{k}")) for k in (1, 2))
    rows = N.parsed(N.parsed(a.join(b, "l_orderkey"), "q1", "reference"), "q2", "candidate")
    return rows.select("l_orderkey", F.round(N.fold(F.col("reference"), F.col("candidate"), "lower"), 9).alias("fold"))


DECLARED = "case l_linenumber when 1 then 'mg/kg' when 2 then '10^6 cells' when 3 then 'h' when 4 then 'unknown' when 5 then '1' else 'U/mL' end"
SUFFIXED = f"case when l_linenumber = 2 then concat(cast(cast(l_quantity as bigint) as string), ' 10^6 cells') when l_linenumber = 6 then concat('<', cast(cast(l_quantity as bigint) as string), 'U/mL') when l_linenumber = 7 then concat(cast(cast(l_quantity as bigint) as string), ' mg') else concat(cast(cast(l_quantity as bigint) as string), case when l_linenumber = 5 then '' else {DECLARED} end) end"


@query("n05_declared_units", "select l_orderkey, l_linenumber, case when l_linenumber in (4, 7) then 'unsupported' when l_linenumber = 6 then 'interval' else 'scalar' end as kind, case when l_linenumber in (4, 7) then null else cast(cast(l_quantity as bigint) as double) end as high from lineitem")
def declared(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that end with their column's own unit, whatever it is; others are left alone."""
    rows = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.expr(SUFFIXED).alias("cell"), F.expr(DECLARED).alias("unit"))
    cells = rows.select("cell", "unit").distinct()
    plain = lambda v: F.struct(v["kind"].alias("kind"), N.approximate(v["high"]).alias("high"))
    known = cells.select("cell", "unit", N.let(N.declared(F.col("cell"), F.col("unit")), plain).alias("v"))
    return rows.join(known, ["cell", "unit"]).select("l_orderkey", "l_linenumber", "v.kind", "v.high")


@query("n09_exact_differences", "select l_orderkey, l_linenumber, round(cast(l_extendedprice as decimal(18, 2)) - cast(l_quantity as decimal(18, 2)), 2)::double as difference from lineitem")
def differences(spark: SparkSession, folder: str) -> DataFrame:
    """Of prices and quantities as they are written, both behind thirty zeros and a one that cancels."""
    rows = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("1000000000000000000000000"), F.format_string("%012.2f", "l_extendedprice")).alias("a"), F.concat(F.lit("1000000000000000000000000"), F.format_string("%012.2f", "l_quantity")).alias("b"))
    rows = N.parsed(N.parsed(rows, "a", "candidate"), "b", "reference")
    return rows.select("l_orderkey", "l_linenumber", N.difference(F.col("reference"), F.col("candidate")).alias("difference"))


TAIL = "case p_size % 6 when 0 then concat(cast(p_size as string), ' nM >', cast(p_size as string)) when 1 then concat('A +++ ', cast(p_size as string), '%') when 2 then 'NT; not determined' when 3 then concat('about ', cast(p_size as string)) when 4 then concat('[1,', cast(p_size as string), '] 3.5±0.2') else concat('1,5 ', cast(p_size as string), 'x') end"


@query("n15_value_tokens", "select p_partkey, case p_size % 6 when 0 then cast(p_size as string) || ' nM|>' || cast(p_size as string) when 1 then 'A|+++|' || cast(p_size as string) || '%' when 4 then '[1,' || cast(p_size as string) || ']|3.5±0.2' end as tokens from part")
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select("p_partkey", F.array_join(text.value_tokens(F.expr(TAIL)), "|").alias("tokens"))


@query("n10_rank_values", f"select v, case when v = 'A' then 'letter' when v = '+++' then 'plus' when regexp_full_match(v, '[0-9]+') then 'numeric' end as kind, case when v = 'A' then 0 when v = '+++' then 3 when regexp_full_match(v, '[0-9]+') then cast(v as double) end as value, count(*) as n from (select {CELL} as v from lineitem) group by v")
def rank_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select(F.expr(CELL).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    rank = N.rank_value(F.col("v"))
    return rows.select("v", rank["kind"].alias("kind"), rank["value"].alias("value"), "n")


NAMES = "case event_type when 'click' then 'IC50' when 'view' then 'pIC50' when 'purchase' then 'Inhibition' when 'scroll' then 'Cell viability' else 'LogD' end"
UNIT = "case user_id % 3 when 0 then 'nM' when 1 then '%' else '' end"


@query("n11_directions", f"select event_id, case when n = 'IC50' and u in ('nM', '') then 'lower' when n = 'pIC50' and u = '' then 'higher' when n = 'Inhibition' and u = '%' then 'higher' when n = 'Cell viability' and u = '%' then 'lower' else 'unknown' end as direction from (select event_id, {NAMES} as n, {UNIT} as u from events)")
def directions(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "events").selectExpr("event_id", f"{NAMES} as n", f"{UNIT} as u")
    return rows.select("event_id", rules.direction(F.col("n"), F.col("u"), F.lit(""))["direction"].alias("direction"))


@query("n12_concentration_units", f"select u, u in ('nM', 'uM', 'mM') as is_concentration from (select distinct {UNITS} as u from lineitem)")
def concentrations(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(F.expr(UNITS).alias("u")).distinct().select("u", rules.is_concentration(F.col("u")).alias("is_concentration"))


@query("n13_identifier_keys", "select p_partkey, case when p_size % 4 = 1 then concat(cast(p_partkey as string), 'A') when p_size % 4 = 2 then concat('I-', cast(p_size as string), '-', cast(p_partkey as string)) else cast(p_partkey as string) end as k from part")
def keys(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select("p_partkey", identifiers.identifier_key(F.expr(PRINTED)).alias("k"))


@query("n14_fragment_conflicts", "select p_partkey, p_size % 2 = 0 and p_partkey <> 0 as conflict from part")
def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    own = F.col("p_partkey").cast("string")
    shown = F.concat(F.lit("see "), F.when(F.col("p_size") % 2 == 0, F.concat(own, F.lit(" and 0"))).otherwise(own), F.lit(" above"))
    return read(spark, folder, "part").select("p_partkey", identifiers.fragments_conflict(shown, own).alias("conflict"))


@query("n16_source_numbers", "select doc_id, regexp_full_match(word, '[+-]?([0-9]+([.,][0-9]+)?|[.,][0-9]+)([eE][+-]?[0-9]+)?%?') as numeric from (select doc_id, coalesce(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '^[0-9]'))[1], '') as word from documents)")
def source_numbers(spark: SparkSession, folder: str) -> DataFrame:
    word = F.coalesce(F.get(F.filter(F.split("text", r"\s+"), lambda w: w.rlike("^[0-9]")), 0), F.lit(""))
    return read(spark, folder, "documents").select("doc_id", text.decimal_comma(word).alias("numeric"))


@query("n17_evidence", f"select raw, try_cast(raw as double) as number, raw like '>%' or raw like '<%' as censored from (select distinct raw from ({OBSERVED}))")
def evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = observed(spark, folder).select("raw").distinct()
    read_ = N.evidence(F.col("raw"))
    return rows.select("raw", read_["number"].alias("number"), read_["censored"].alias("censored"))


@query("n18_context_ids", "select l_returnflag, l_linestatus, sha256('[\"' || l_returnflag || '\",\"' || l_linestatus || '\",null]') as context_id from (select distinct l_returnflag, l_linestatus from lineitem)")
def context_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    return rows.select("l_returnflag", "l_linestatus", contexts.context_id(F.col("l_returnflag"), F.col("l_linestatus"), F.lit(None)).alias("context_id"))


@query("n19_stable_digests", "select n_nationkey, sha256('{\"a\":\"' || n_name || '\",\"b\":\"' || cast(n_regionkey as string) || '\"}') as digest from nation")
def digests(spark: SparkSession, folder: str) -> DataFrame:
    values = F.create_map(F.lit("b"), F.col("n_regionkey").cast("string"), F.lit("a"), F.col("n_name"))
    return read(spark, folder, "nation").select("n_nationkey", contexts.map_digest(values).alias("digest"))


@query("n20_declarations", "select p_partkey, p_brand as target, p_type as assay, p_size || ' h' as duration, case when p_size % 4 <> 0 then 'b' || p_size end as batch, case when p_size % 3 = 0 then 'duration' else '' end as conflicts from part")
def declarations(spark: SparkSession, folder: str) -> DataFrame:
    """Captions in two languages, with a line break behind a label, an unknown batch, and for some parts two durations."""
    size = F.col("p_size").cast("string")
    caption = F.concat(F.lit("Table 1. x; Target: "), "p_brand", F.lit(" Assay name： "), "p_type", F.lit("; Treatment duration:\n"), size, F.lit(" h; 批次: "), F.when(F.col("p_size") % 4 == 0, "not recorded").otherwise(F.concat(F.lit("b"), size)), F.when(F.col("p_size") % 3 == 0, "\nDuration: 99 h").otherwise(""))
    found = text.conditions(caption)
    values = found["values"]
    return read(spark, folder, "part").select("p_partkey", *[values[k].alias(k) for k in ("target", "assay", "duration", "batch")], F.array_join(found["conflicts"], ",").alias("conflicts"))


@query("n21_section_roles", "select p_partkey, case p_size % 5 when 0 then 'claims' when 1 then 'bioassay' when 2 then 'synthesis' when 3 then 'background' else 'other' end as role from part")
def roles(spark: SparkSession, folder: str) -> DataFrame:
    heading = F.element_at(F.array(*[F.lit(h) for h in ("What is claimed is", "Test Example 3", "Example 12", "BACKGROUND OF THE INVENTION", "Conclusion")]), F.col("p_size") % 5 + 1)
    return read(spark, folder, "part").select("p_partkey", text.section_role(heading).alias("role"))


@query("n22_metric_headers", "select p_partkey, case p_size % 6 when 0 then p_name || ' IC50 (nM)' when 1 then 'DC50 (uM)' when 2 then 'Ki (unit unknown)' when 3 then 'Ratio' when 4 then 'Unknown activity field 7: EC50 Ki (unit unknown)' else 'Unknown activity field 7: ' || p_brand || ' (x)' end as field, case p_size % 6 when 2 then 1 when 3 then 1 when 4 then 2 when 5 then 0 else 1 end as n_metrics from part")
def metric_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers with gaps and other glyphs, touching units, no unit, several metrics or none."""
    forms = [F.concat("p_name", F.lit(" I C 5O (n M)")), F.lit("DC₅₀uM"), F.lit("K_i"), F.lit("Ratio"), F.lit("EC50 Ki"), F.concat("p_brand", F.lit(" (x)"))]
    header = F.get(F.array(*forms), F.col("p_size") % 6)
    return read(spark, folder, "part").select("p_partkey", headers.field_name(header, F.lit(7)).alias("field"), F.size(headers.metrics(header)).alias("n_metrics"))


@query("n23_text_rows", "select p_partkey, line, cpd, ic50, review from (select p_partkey, 2 as line, 'Compound ' || p_partkey as cpd, case when p_size % 3 = 1 and p_size % 4 = 1 then '' else cast(p_size as varchar) end as ic50, p_size % 4 = 1 as review from part where p_size % 3 <> 2 union all select p_partkey, 3, 'DMSO', case when p_size % 3 = 1 then '' else '>50' end, p_size % 3 = 1 from part where p_size % 3 <> 2)")
def text_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with one table each: between bars, with blank space, or without a header; prose and what follows a stop give no rows."""
    n, own = F.col("p_size"), F.col("p_size").cast("string")
    bars = F.concat(F.lit("Target: x\nNo. | IC50 (nM) | Ki (µM)\nCpd "), F.col("p_partkey").cast("string"), F.lit(" | "), own, F.when(n % 4 == 1, " | about 3").otherwise(" | A"), F.lit("\nDMSO | >50 | NT\nNote: all\n7 | 8 | 9"))
    blank = F.concat(F.lit("Target: x\nCompound No. IC50 (nM) Ki (µM)\nCpd "), F.col("p_partkey").cast("string"), F.lit(" "), own, F.when(n % 4 == 1, " 4 5").otherwise(" ND"), F.lit("\nDMSO >50\n12 mice were given 5 mg\n* end\n8 9 10"))
    page = F.when(n % 3 == 0, bars).when(n % 3 == 1, blank).otherwise("Results\n5 | 6")
    rows = text_tables.table_rows(read(spark, folder, "part").select("p_partkey", page.alias("page")), ["p_partkey"], "page")
    return rows.select("p_partkey", "line", "cpd", F.col("values")["IC50 (nM)"].alias("ic50"), F.col("needs_review").alias("review"))


@query("n24_legends", "select p_partkey, case when p_size % 3 <> 0 then '<' || cast(p_size as string) || ' nM' end as a, case when p_size % 3 <> 0 then 'rest' end as b, case when p_size % 3 = 0 then 'conflicting_definitions' else '' end as issues from part")
def legends(spark: SparkSession, folder: str) -> DataFrame:
    """Each part's pages declare what grades mean; the second page says it again, for some parts in other words."""
    line = F.concat(F.lit("The letter codes for IC50  include: A (<"), F.col("p_size").cast("string"), F.lit(" nM), B ("), F.col("rest"), F.lit("). Table 4. X (1)"))
    pages = read(spark, folder, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"))
    pages = pages.withColumn("rest", F.when((F.col("page") == 2) & (F.col("p_size") % 3 == 0), "other").otherwise("rest"))
    found = text_tables.grade_legends(pages.select("p_partkey", "page", line.alias("said")), ["p_partkey"], "page", "said")
    sound = F.size("issues") == 0
    return found.select("p_partkey", F.when(sound, F.col("grades")["A"]).alias("a"), F.when(sound, F.col("grades")["B"]).alias("b"), F.array_join("issues", ",").alias("issues"))


@query("n25_levenshtein", "select p_partkey, cast(levenshtein(p_name, p_type) as int) as distance from part")
def distance(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query("n26_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_valid(props) as valid from events")
def json(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


#: What may look like SMILES, or not: round and square brackets, dots, other characters, no carbon, too short, empty.
LOOKS = ("c1ccccc1(O)", "c1ccccc(O", "CC", "C$C[N", "N#N..O", "CCO.", "", "[Na+].[Cl-]", "O=S(=O)", "C" * 501)


@query("n27_smiles_scores", f"""with s as (select p_partkey, case when p_size % 11 < 10 then ({list(LOOKS)})[p_size % 11 + 1] end as s from part)
 select p_partkey, case when s is null or length(s) < 3 then 0e0 else round(greatest(0e0, 1e0 - case when regexp_full_match(s, '[a-zA-Z0-9\\[\\]()=#@+/\\\\.:%-]*') then 0 else 0.3e0 end - case when length(replace(s, '[', '')) <> length(replace(s, ']', '')) then 0.3e0 else 0 end - case when length(replace(s, '(', '')) <> length(replace(s, ')', '')) then 0.2e0 else 0 end
 - case when contains(s, '..') then 0.2e0 else 0 end - case when s like '.%' or s like '%.' then 0.1e0 else 0 end - case when contains(lower(s), 'c') then 0 else 0.2e0 end - case when length(s) between 5 and 500 then 0 else 0.2e0 end), 6) end as score from s""")
def smiles(spark: SparkSession, folder: str) -> DataFrame:
    made = F.get(F.array(*[F.lit(x) for x in LOOKS]), F.col("p_size") % 11)
    return read(spark, folder, "part").select("p_partkey", F.round(text.smiles_score(made), 6).alias("score"))


@query("n28_content_hash", "select doc_id, sha256(text) as h from documents")
def content(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))


@query("n29_fix_rules", "select p_partkey, replace(regexp_replace(p_name, '[aeiou]', '_', 'g'), 'l', '1') as fixed from part")
def fixes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select("p_partkey", text.fixed(F.col("p_name"), [("[aeiou]", "_", True), ("l", "1", False)]).alias("fixed"))


@query("n30_messages", "select p_partkey, p_name as m, 1 as n from part")
def messages(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.array(F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   ")), F.lit(" "), F.col("p_name"))
    found = text.messages(raw)
    return read(spark, folder, "part").select("p_partkey", found[0].alias("m"), F.size(found).alias("n"))


@query("n31_timestamps", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as at from events")
def timestamps(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
