"""S, K and streaming queries: reading, exporting, upserts, sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import formula_safe, tab_line
from tessera.operators import overlays
from tessera.sources import exports, revisions, scratch, tables
from tessera.streaming import states

from .aggregates import fingerprint_sql
from .registry import query, read


@query("s01_csv", "select cast(p_partkey as varchar) as id, p_name || chr(10) || '\"' || p_type || '\"; ' || p_brand as text, case when p_size % 7 = 0 then '' else chr(39) || p_size end as size from part")
def csv(spark: SparkSession, folder: str) -> DataFrame:
    """Written with semicolons, quotes and line breaks inside cells, and read back; the separator is found."""
    cell = F.concat("p_name", F.lit('\n"'), "p_type", F.lit('"; '), "p_brand")
    rows = read(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("id"), cell.alias("text"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("'"), F.col("p_size").cast("string"))).alias("size"))
    path = f"{scratch.scratch_folder(spark)}/tessera-csv-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("sep", ";").option("escape", '"').option("quoteAll", True).csv(path)
    return tables.csv(spark, path)


@query("s02_wide_to_long", "select p_partkey, metric, unit, value from (select p_partkey, 'size' as metric, 'mm' as unit, cast(p_size as string) as value from part union all select p_partkey, 'grade', null, p_brand from part where p_size > 10)")
def wide(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("string").alias("size (mm)"), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(" ").alias("grade"))
    long = tables.observations(rows, tables.Mapping("id", wide=("size (mm)", "grade")))
    return long.select(F.col("identifier").cast("long").alias("p_partkey"), "metric", "unit", "value")


@query("s03_role_defaults", "select p_partkey, case when p_size % 2 = 0 then 'Compound ID' end as identifier, 'ＳＭＩＬＥＳ' as structure, case when p_size % 3 = 0 then p_brand || ' value' when p_size % 3 = 1 then 'Result' end as other, case when p_size % 3 = 1 then 'Result' end as value, 'Units' as unit from part")
def defaults(spark: SparkSession, folder: str) -> DataFrame:
    """The headers of each part's table, some with two candidates for a role or with none."""
    n = F.col("p_size")
    result = F.when(n % 3 == 0, F.concat("p_brand", F.lit(" value"))).when(n % 3 == 1, "Result")
    headers = F.array_compact(F.array(F.lit("Compound ID"), F.when(n % 2 == 1, "la_bel"), F.lit("ＳＭＩＬＥＳ"), result, F.when(n % 3 == 2, "value"), F.when(n % 3 == 2, "Activity"), F.lit("Units")))
    found = tables.default_roles(headers)
    return read(spark, folder, "part").select("p_partkey", found["identifier"].alias("identifier"), found["structure"].alias("structure"), result.alias("other"), found["value"].alias("value"), found["unit"].alias("unit"))


@query("s04_context_columns", "select event_id, json_extract_string(props, '$.k') as k from events")
def context_columns(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", tables.map_field(F.col("props"))["k"].alias("k"))


@query("s05_expanded_parts", "select d.doc_id, s.n from documents d join (select source, count(*) as n from documents group by source) s using (source)")
def expanded(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source")
    parts = docs.groupBy(F.col("source").alias("ref")).agg(F.count("*").alias("n"))
    return tables.expanded(docs, parts, "source").select("doc_id", "n")


@query("s06_project_scan", "select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l using (doc_id)")
def scan(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", "source").join(read(spark, folder, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query("s07_molecule_search", "select p_partkey from part where contains(lower(p_name), 'an') or contains(lower(p_type), 'an')")
def search(spark: SparkSession, folder: str) -> DataFrame:
    return tables.searched(read(spark, folder, "part"), "AN", ["p_name", "p_type"]).select("p_partkey")


@query("s08_json_arrays", "select o_orderkey, l_returnflag as name, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by 1, 2")
def json_arrays(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_returnflag").alias("name")))).alias("payload"))
    rows = tables.json_array(read(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "payload"), "payload", "struct<name: string>")
    return rows.groupBy("o_orderkey", F.col("item.name").alias("name")).agg(F.count("*").alias("n"))


@query("s10_new_pages", "select page_id from pages where page_id % 3 = 0 or page_id % 7 = 0")
def new_pages(spark: SparkSession, folder: str) -> DataFrame:
    wanted = read(spark, folder, "pages").select("page_id")
    cache = wanted.where("page_id % 3 <> 0").select("page_id", F.when(F.col("page_id") % 7 == 0, "").otherwise("x").alias("text"), F.lit(1).alias("tries"))
    return tables.new_pages(wanted, cache, ["page_id"])


SNAPSHOT = """e as (select source, doc_id, coalesce(n, lang) as lang, r as __revision, case quality when 0 then 'rejected' when 1 then 'accepted' end as decision from documents left join (select item_id as doc_id, 'xx' as n, 2 as r from benchmark) using (doc_id) left join labels using (doc_id))"""
SNAPSHOT_ROW = """select source, '{"doc_id":' || doc_id || ',"__revision":' || coalesce(cast(__revision as varchar), 'null') || ',"decision":' || coalesce('"' || decision || '"', 'null') || ',"rules":"v1","lang":"' || lang || '"}' as j from e"""


@query("s11_project_snapshot", f"with {SNAPSHOT}, {fingerprint_sql(SNAPSHOT_ROW, 'source')} select w.source, w.n, w.fingerprint as revision, count(e.doc_id) as n_effective from w left join e on e.source = w.source and coalesce(e.decision, '') <> 'rejected' group by all")
def project_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as records and sources as projects; benchmark ids are corrected, labels are the reviews."""
    docs = read(spark, folder, "documents").select("source", "doc_id", "lang")
    corrections = read(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(2).alias("revision"), F.lit("xx").alias("lang"))
    reviews = read(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 0, "rejected").when(F.col("quality") == 1, "accepted").alias("decision"))
    rows, revisions = tables.snapshot(docs, "source", "doc_id", docs.limit(0), corrections, reviews, ["lang"], "v1")
    return revisions.join(rows.groupBy("source").agg(F.count("*").alias("n_effective")), "source", "left").na.fill(0, ["n_effective"]).select("source", "n", "revision", "n_effective")


@query("k01_long_export", "select c_custkey, o_orderkey, o_orderstatus from customer left join orders on c_custkey = o_custkey")
def long_export(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("activities"))
    return exports.long_rows(read(spark, folder, "customer").join(orders, "c_custkey", "left"), ["c_custkey"], "activities")


@query("k02_formula_escape", "select p_partkey, case when p_size % 3 = 0 then '''=' || p_name when p_size % 3 = 1 then ''' -' || p_name else p_name end as safe from part")
def escape(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("="), "p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" -"), "p_name")).otherwise(F.col("p_name"))
    return read(spark, folder, "part").select("p_partkey", formula_safe(raw).alias("safe"))


@query("k03_json_documents", "select n_regionkey, count(*) as n_items from nation group by 1")
def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    made = exports.json_document(read(spark, folder, "nation"), ["n_regionkey"], ["n_nationkey"])
    return made.select("n_regionkey", F.get_json_object("document", "$.n_items").cast("long").alias("n_items"))


@query("k04_selected", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def selected(spark: SparkSession, folder: str) -> DataFrame:
    ids = read(spark, folder, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return exports.selected(read(spark, folder, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query("k05_catalogue_sheet", "select c_custkey, string_agg(o_orderstatus, ' | ' order by o_orderkey) as states from customer left join orders on c_custkey = o_custkey group by 1")
def sheet(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderstatus").alias("states"))
    return exports.sheet(read(spark, folder, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey", "states")


@query("k06_structure_blocks", "select count(*) as n from part where p_size > 20")
def blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "part").withColumn("block", F.when(F.col("p_size") > 20, F.concat("p_name", F.lit("\nM  END"))))
    return exports.structure_file(rows, "block", ["p_partkey", "p_brand"]).agg(F.count_if(F.col("value").endswith("$$$$")).alias("n"))


@query("k07_study_export", "select p_brand, count(*) as n_rows, sum(p_size)::bigint as size from part group by 1")
def study(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").groupBy("p_brand").agg(F.count("*").alias("n_rows"), F.sum("p_size").alias("size"))


@query("k08_published", "select c_nationkey, c_custkey, case when c_nationkey < 5 then 'new' else 'old' end as edition from customer where c_nationkey >= 5 or c_acctbal > 0")
def published(spark: SparkSession, folder: str) -> DataFrame:
    """Published twice; the second edition replaces only the nations that it holds."""
    path = f"{scratch.scratch_folder(spark)}/tessera-published-{uuid.uuid4().hex}"
    rows = read(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    exports.publish(rows.withColumn("edition", F.lit("old")), path, ["c_nationkey"])
    exports.publish(rows.where("c_nationkey < 5 and c_acctbal > 0").withColumn("edition", F.lit("new")), path, ["c_nationkey"])
    return spark.read.parquet(path).select("c_nationkey", "c_custkey", "edition")


@query("k11_revisions", "select o_orderkey, case when o_totalprice > 100000 then 'second' else 'first' end as edition from orders union all select o_orderkey, 'third' from orders where o_orderpriority = '5-LOW'")
def revised(spark: SparkSession, folder: str) -> DataFrame:
    """Two writers read the first revision: the later one is refused, reads again, and adds its rows to the other's."""
    path = f"{scratch.scratch_folder(spark)}/tessera-revisions-{uuid.uuid4().hex}"
    orders = read(spark, folder, "orders")
    seen = revisions.publish(orders.select("o_orderkey", "o_totalprice", F.lit("first").alias("edition")), path, 0)
    dearer = F.when(F.col("o_totalprice") > 100000, "second").otherwise(F.col("edition"))
    revisions.publish(revisions.read(spark, path, seen).withColumn("edition", dearer), path, seen)
    low = orders.where("o_orderpriority = '5-LOW'").select("o_orderkey", "o_totalprice", F.lit("third").alias("edition"))
    try:
        revisions.publish(revisions.read(spark, path, seen).union(low), path, seen)
    except revisions.StaleRevision:
        revisions.updated(spark, path, lambda rows: rows.union(low))
    return revisions.read(spark, path).select("o_orderkey", "edition")


@query("k09_tsv", "select n_nationkey::varchar || chr(9) || n_name as line from nation")
def tsv(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select(tab_line(F.col("n_nationkey"), F.col("n_name")).alias("line"))


@query("k10_upsert", "select p_partkey, case when p_partkey % 5 = 0 then 'new' else p_brand end as p_brand, case when p_partkey % 5 = 0 then 2 else 1 end as revision from part union all select -1, 'added', 1")
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    base = read(spark, folder, "part").select("p_partkey", "p_brand", F.lit(1).alias("revision"))
    changed = base.where("p_partkey % 5 = 0").select("p_partkey", F.lit("new").alias("p_brand"), F.lit(2).alias("revision"))
    stale = base.where("p_partkey % 5 = 1").select("p_partkey", F.lit("old").alias("p_brand"), F.lit(0).alias("revision"))
    added = spark.createDataFrame([(-1, "added", 1)], "p_partkey long, p_brand string, revision int")
    return overlays.upsert(base, changed.unionByName(stale).unionByName(added), ["p_partkey"], "revision")


@query("k11_snapshot_replace", "select o_orderkey, o_orderpriority from orders where o_orderpriority <> '1-URGENT' union all select o_orderkey, o_orderpriority from orders where o_orderpriority = '1-URGENT' and o_totalprice > 200000")
def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    base = read(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    new = base.where("o_orderpriority = '1-URGENT' and o_totalprice > 200000")
    return overlays.replaced_snapshot(base, new, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query("k12_activity_sheet", "select o_orderkey, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity = 10) then 1 else 0 end as has_source from orders where o_orderkey in (select l_orderkey from lineitem)")
def activity_sheet(spark: SparkSession, folder: str) -> DataFrame:
    sources = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array(F.struct(F.collect_list(F.struct(F.lit("q").alias("field"), F.col("l_quantity").cast("long").cast("string").alias("value"))).alias("cells"))).alias("sources"))
    rows = sources.select(F.col("l_orderkey").alias("o_orderkey"), F.lit("q").alias("field"), F.lit("10").alias("value"), "sources")
    known = read(spark, folder, "orders").select("o_orderkey")
    made = exports.activity_sheet(rows.join(known, "o_orderkey", "left_semi"), ["o_orderkey"], "field", "value", "sources")
    return made.select("o_orderkey", F.when(F.col("source").isNull(), 0).otherwise(1).alias("has_source"))


@query("t_sessions", "select user_id, min(ts) as begun, count(*) as n_events from (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as b from events window w as (partition by user_id order by ts, event_id))) group by user_id, s")
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return states.sessions(read(spark, folder, "events"), "user_id", "ts", "30 minutes").select("user_id", "begun", "n_events")


@query("t_progress", "select user_id, max(least(event_id, 1000)) as done, max(1000)::bigint as total from events group by 1")
def progress(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "events").select("user_id", F.col("event_id").alias("done"), F.lit(1000).cast("long").alias("total"))
    return states.progress(rows, ["user_id"], "done", "total")


@query("t_windows", "select time_bucket(interval 1 hour, ts) as begun, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = states.windowed(read(spark, folder, "events"), "ts", "1 hour", ["event_type"], F.col("value"))
    return rows.select("begun", "event_type", "n", F.round("total", 4).alias("total"))


@query("t_requests", "select event_id, case when n = 1 then 'new' when event_type = f then 'same' else 'conflict' end as verdict from (select event_id, event_type, row_number() over w as n, first_value(event_type) over w as f from events window w as (partition by user_id order by ts, event_id))")
def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Users as request ids and event types as their contents."""
    return states.request_verdicts(read(spark, folder, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "verdict")


@query("t_resumed_batches", "select event_id, event_type from events")
def resumed_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the events table, run twice over one checkpoint: the second run adds nothing."""
    base = f"{scratch.scratch_folder(spark)}/tessera-batches-{uuid.uuid4().hex}"
    schema = read(spark, folder, "events").select("event_id", "event_type").schema
    read(spark, folder, "events").select("event_id", "event_type").repartition(4, "event_id").write.parquet(f"{base}/in")
    for _ in range(2):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        states.checkpointed(source, f"{base}/out", f"{base}/state", ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type")


@query("t_sealed_windows", "select cast(7 as bigint) as n_files, count(*) as n_rows, cast(3 as bigint) as n_windows from documents")
def sealed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Seven files in windows of three, each sealed when it is written."""
    base = f"{scratch.scratch_folder(spark)}/tessera-sealed-{uuid.uuid4().hex}"
    read(spark, folder, "documents").select("doc_id").repartition(7).write.parquet(f"{base}/in")
    states.sealed_windows(spark, f"{base}/in", "doc_id long", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out/seals").agg(F.sum("n_files").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_windows"))


@query("t_latest_state", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1")
def latest(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").select("user_id", "event_id", "event_type")
    first = overlays.latest(events.where("event_type in ('click', 'view')"), ["user_id"], F.desc("event_id"))
    second = overlays.latest(events.where("event_type not in ('click', 'view')"), ["user_id"], F.desc("event_id"))
    return states.latest_state([first, second], ["user_id"], "event_id")
