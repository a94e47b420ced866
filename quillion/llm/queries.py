"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.llm import audio, chat, jaccard_join, langid, packing, quality, sentencepiece_codec, sharding, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio.store(_table(spark, sf_dir, "documents"))
    found = audio.read(media, ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "pcm")


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


SEQUENCE_TOKENS = 2048


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), SEQUENCE_TOKENS)


@_query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


TOKEN_LIMIT = 4096


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "prefix_changes")


SHARDS = 24


@_query
def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@_query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


#: The listed canonical URLs of the contract.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(URL_RULES, "entry string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), listed)


ORACLE["op8_url_filter"] = """
with listed(entry, v) as (values ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
rest as (select row_number() over () as r, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as x from pages),
parts as (select r, page_id, translate(regexp_extract(x, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(x, '^[^/?#]*([^?#]*)', 1) as path from rest),
fits as (select r, entry, v, row_number() over (partition by r order by length(entry) desc, instr(entry, '/') desc) as k from parts, listed
         where starts_with(path, substr(entry, instr(entry, '/'))) and (host = split_part(entry, '/', 1) or ends_with(host, '.' || split_part(entry, '/', 1))))
select page_id, host, path, entry as rule, coalesce(v, 'allow') as verdict
from parts left join (select * from fits where k = 1) using (r)
"""


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("broken_rules")


def _quality_sql() -> str:
    space = r"[^\x20\x09-\x0D]+"
    stop = sorted({w for ws in quality.STOP_WORDS.values() for x in ws for w in (x, x.capitalize())})
    listed = ", ".join(f"'{w}'" for w in stop)
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '{space}') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) as ls from d),
c as (select r, doc_id, t, ws, ls, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(regexp_extract_all(t, '[!{{}}~^=_\\]'))::bigint as own,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
             len(list_filter(ws, lambda x: x in ({listed})))::bigint as stop,
             len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1]))::bigint as adjacent from w),
wins as (select r, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') as win from (select r, ws, unnest(range(1, len(ws) - 3)) as i from c where len(ws) >= 5)),
rep as (select r, i, count(*) over (partition by r, win) as n from wins),
cov as (select r, count(distinct i + k)::bigint as n_repeat_words from rep, (select unnest(range(0, 5)) as k) where n >= 2 group by r),
j as (select c.*, coalesce(n_repeat_words, 0) as n_repeat_words, greatest(len(ls), 1) as nl, greatest(n_words, 1) as nw from c left join cov using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from j)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars >= 2 * nw and word_chars <= 12 * nw and n_symbols / nw <= 0.1 and own / nw <= 0.3
  and not (n_words >= 50 and stop / nw < 0.01) and n_dup_lines / nl <= 0.5 and word_chars / nl <= 100000 and adjacent / nw <= 0.3 as kept
from b
"""


ORACLE["op9_quality_rules"] = _quality_sql()


#: The conversation that the contract adds.
ADDED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string"))
    # The numbering of turns has dealt the log by conversation.
    return chat.read_back(chat.fold(chat.events_of(rows), dealt=True))
