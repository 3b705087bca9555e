"""The named queries of this subpackage over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vaxframe.llm import (
    conversations, decontaminate, host_reputation, line_store, outliers, personal_data, pieces, quality_model, ranked_search, reshard,
    secret_index, shingle_join, substrings,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_digest(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.similar_documents(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.rules_digest(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_index.secrets_digest(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.shards_digest(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired; not in SQL (a search per conversation), tested against dynamic programming."""
    return conversations.repair_digest(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that a larger doc_id keeps."""
    return line_store.lines_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_pii": op4_pii,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scans": op7_secret_scans,
    "op8_url_filters": op8_url_filters,
    "op9_sharding": op9_sharding,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_line_dedup": op13_line_dedup,
}

#: Words between ASCII white space, of a whole text (null: none).
SPACE_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

#: A document's set of distinct 5-word shingles.
SHINGLES = rf"""
w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as ws from documents),
sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as s from w),
token as (select doc_id, unnest(s) as t from sets),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from token a join token b using (t) where a.doc_id < b.doc_id group by all),
link as (select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
edge as (select a, b from link union all select b, a from link),
reach(node, root) as (select doc_id, doc_id from sets union select b, root from reach join edge on a = node)"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"list_filter(string_split_regex({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": f"""
with d as (select doc_id, {ALNUM_WORDS} as ws from documents),
b as (select item_id, {ALNUM_WORDS} as ws from benchmark),
size as (select distinct least(10, len(ws)) as k from b where len(ws) > 0),
bw as (select distinct item_id, least(10, len(ws)) as k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as s
  from b, unnest(range(1, greatest(len(ws) - 8, 2))) u(i) where len(ws) > 0),
dw as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as s from d, size, unnest(range(1, len(ws) - k + 2)) u(i)),
found as (select doc_id, k, i, item_id from dw join bw using (k, s)),
hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from found) group by doc_id),
item as (select doc_id, count(*) as n, string_agg(x, ',' order by x) as t from (select distinct doc_id, cast(item_id as varchar) as x from found) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(item.n, 0) as n_items,
  sha256(coalesce(t, '')) as items_sha256, hit.n is not null as contaminated
from d left join hit using (doc_id) left join item using (doc_id)""",
    "op5_ngram_jaccard_join": f"""
with recursive {SHINGLES}
select doc_id, cast(len(s) as bigint) as n_shingles, component_id
from sets join (select node as doc_id, min(root) as component_id from reach group by node) using (doc_id)""",
    "op10_substring_dedup": f"""
with w as (select doc_id, {SPACE_WORDS} as ws from documents),
place as (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w),
win as (select doc_id, i, array_to_string(ws[i:i + 34], ' ') as s from place),
rep as (select s from win group by s having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from win join rep using (s)),
word as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from word anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)""",
    "op12_ranked_search": f"""
with d as (select doc_id, {ALNUM_WORDS} as ws from documents),
word as (select doc_id, len(ws) as n, unnest(ws) as t from d),
total as (select cast(count(distinct doc_id) as bigint) as n_docs, cast(count(*) as bigint) as n_terms from word),
tf as (select doc_id, n, t, count(*) as tf from word group by all),
want as (select item_id, unnest(list_distinct(ws)) as t from (select item_id, {ALNUM_WORDS} as ws from benchmark)),
weight as (select t, cast(floor(1000 * ln((2.0 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by t, n_docs),
part as (select item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) as x from want join tf using (t) join weight using (t), total),
scored as (select item_id, doc_id, cast(sum(x) as bigint) as score from part group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scored where score > 0)
select item_id, cast(r as int) as rank, doc_id, score from ranked where r <= 10""",
    "op13_line_dedup": r"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
line as (select doc_id, unnest(ls) as x, unnest(range(1, len(ls) + 1)) as p from s),
keyed as (select *, translate(trim(x, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from line),
active as (select k, max(doc_id) as top from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
kept as (select doc_id, count(*) as n, string_agg(x, chr(10) order by p) as t from keyed left join active using (k) where top is null or top = doc_id group by doc_id)
select doc_id, cast(len(ls) as bigint) as n_lines, cast(len(ls) - coalesce(n, 0) as bigint) as n_dropped, sha256(coalesce(t, '')) as kept_sha256
from s left join kept using (doc_id)""",
}
