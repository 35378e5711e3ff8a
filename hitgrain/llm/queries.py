"""The operators on the driver tables, and the same questions in SQL where SQL can ask them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgrain.llm import (
    ann,
    divergence,
    exact_dedup,
    mixing,
    near_dedup,
    packing,
    quality,
    sharding,
    suffix_dedup,
    token_output,
    url_filter,
    vector_codes,
    warc_zip,
)
from hitgrain.llm.common import ROW, table

# The rules of the url query.
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select(F.col(ROW)["page_id"].alias("page_id"), "host", "path", "rule", "verdict")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = exact_dedup.label_copies(docs)
    return labelled.select(F.col(ROW)["doc_id"].alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.label_near_copies(docs).drop("text_hash")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.sample_mix(docs)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select(F.col(ROW)["doc_id"].alias("doc_id"), "size", "source_size", "target", taken)


def tokenizer_path() -> str:
    """Where the vocabulary lies; ``HITGRAIN_TOKENIZER`` names another file."""
    if "HITGRAIN_TOKENIZER" in os.environ:
        return os.environ["HITGRAIN_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge_quality(docs, table(spark, sf_dir, "labels"))
    return judged.select(F.col(ROW)["doc_id"].alias("doc_id"), F.col(ROW)["lang"].alias("lang"), "bits", "perplexity", "threshold", "kept")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output.token_digests(token_output.token_table(docs, tokenizer_path()))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.repeat_digests(suffix_dedup.remove_repeats(docs))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.packed_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path())


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest_neighbours(rows, lambda vec_id: vec_id % 50 == 0)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_digests(sharding.sharded_documents(docs, sharding.hash_tree()))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded = vector_codes.compress_vectors(rows)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_token_output": op6_token_output,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc_zip": op8_warc_zip,
    "op9_packing": op9_packing,
    "op10_neighbours": op10_neighbours,
    "op11_divergence": op11_divergence,
    "op12_sharding": op12_sharding,
    "op13_vector_codes": op13_vector_codes,
}

_RULE_ROWS = ", ".join(
    f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for rule, verdict in URL_RULES
)
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_url_filters": f"""
with rules(rule, rule_host, rule_path, verdict) as (values {_RULE_ROWS}),
parts as (
  select page_id, url, row_number() over () as n,
    coalesce({LOWER.format("regexp_extract(url, '://([^/?#]*)([^?#]*)', 1)")}, '') as host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
fits as (
  select n, arg_max(rule, length(rule) * 1000 + length(rule_host)) as rule,
    arg_max(verdict, length(rule) * 1000 + length(rule_host)) as verdict
  from parts join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fits using (n)
""",
    "op8_warc_zip": """
with t as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, coalesce(html, '') as payload from pages),
m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload) end as last from t)
select page_id, payload_bytes, sha1(payload) as payload_digest,
  case when last is distinct from page_id and last is not null then 'revisit' else 'response' end as record_type,
  case when last is distinct from page_id then last end as refers_to
from m
""",
    "op2_exact_dedup": f"""
with t as (select doc_id, {LOWER.format("coalesce(text, '')")} as norm from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  row_number() over (partition by norm order by doc_id desc nulls last) = 1 as kept, sha256(norm) as text_sha256
from t
""",
    "op11_divergence": f"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    {LOWER.format("coalesce(text, '')")} as norm
  from documents),
w as (select id, lang, source, unnest(regexp_extract_all(norm, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct id) >= 10),
c as (select lang, source, term, count(*)::hugeint as n from w join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*)::hugeint as terms from kept group by lang),
full_counts as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, v.terms,
    sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total
  from g join kept k using (lang) join v using (lang) left join c using (lang, source, term)),
p as (select *, 1 + (1000000000::hugeint * (n + 2)) // (total + 2 * terms)::hugeint as p from full_counts),
q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // (sum(sum(n)) over (partition by lang) + 2 * any_value(terms))::hugeint as q
  from full_counts group by lang, term),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
marked as (
  select lang, source, term as item, (p - q) * (p - q) // (p + q) as value
  from p join q using (lang, term) where n > 0 and p > q),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', item, value from marked)
select lang, source, part, item, value::bigint as value,
  row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
from found qualify part = 'pair' or rank <= 10
""",
}
