"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, content_sort, decontam, line_dedup, middle, packing, pii, quality, quality_rules, repair, simhash, token_prefix, toxicity
from .common import held_out

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_prefix.prefix_token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budget=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), F.col("fits").alias("chars_in_limit"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = line_dedup.dropped_lines(docs, exact_words=1)
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return docs.select("doc_id", n_lines).join(gone, "doc_id", "left").select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), F.array_join(dropped.cast("array<string>"), ",").alias("dropped"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), pii.fit(pii.labelled_table(spark)))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in pii.KINDS]
    added = F.size("added").cast("long")
    more = [added.alias("n_added"), (F.size("base").cast("long") + added).alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"), *more)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chats(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "n_turns", F.length("chat").cast("long").alias("n_chars"), F.md5(F.col("chat").cast("binary")).alias("chat_md5"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations")
    return repair.audited(log, repair.damaged(log))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Quality rules, PII, learned scores, token ids, 64-bit fingerprints and cheapest edits are beyond SQL; tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
w as (select doc_id, pos, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from l),
k as (select doc_id * 1000000 + pos as place, doc_id, pos, ws, array_to_string(ws, ' ') as line from w where len(ws) > 0),
f as (select line, any_value(ws) as ws, min(place) as first from k group by line),
v as (select line, first, i, array_to_string(ws[1:i - 1] || ws[i + 1:], ' ') as key from (select line, first, ws, unnest(range(1, len(ws) + 1)) as i from f where len(ws) >= 5)),
g as (select key, i, min(first) as head from v group by key, i having count(*) > 1),
near as (select v.line from v join g on v.key = g.key and v.i = g.i where v.first > g.head
 union select case when v.first > f.first then v.line else f.line end from v join f on v.key = f.line and len(f.ws) >= 5),
gone as (select k.doc_id, k.pos from k join f on k.line = f.line where k.place <> f.first or k.line in (select line from near))
select d.doc_id, cast(len(any_value(d.ls)) as bigint) as n_lines, count(gone.pos) as n_dropped, coalesce(string_agg(cast(gone.pos as varchar), ',' order by gone.pos), '') as dropped
from d left join gone on gone.doc_id = d.doc_id group by d.doc_id""",
    "op9_chat_formatting": """
with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as place, count(*) over (partition by conv_id) as n
 from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
p as (select conv_id, place, n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by place rows unbounded preceding) as upto from t),
kept as (select min(conv_id) as conv_id from p where place = n and upto not in (select upto from p where place < n) group by upto),
c as (select t.conv_id, t.n, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' order by place) as chat from t join kept on t.conv_id = kept.conv_id group by t.conv_id, t.n)
select conv_id, n as n_turns, length(chat) as n_chars, md5(chat) as chat_md5 from c""",
    "op11_exact_dedup": """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256 from t""",
    "op12_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
t as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as ts, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select doc_id, text, len(ts) as n, array_to_string(ts[1:least(h1 % (len(ts) + 1), h2 % (len(ts) + 1))], '') as p, array_to_string(ts[least(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) + 1:greatest(h1 % (len(ts) + 1), h2 % (len(ts) + 1))], '') as m, array_to_string(ts[greatest(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) + 1:], '') as s,
 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from t)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from c""",
}
