"""The queries of this package, over the tables of a folder, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm import bpe, decontaminate, html_extract, mixing, ngram_join, pii, prefix_trie, secret_scan, sharding, topk, toxicity, url_filter, whitening
from tillwatch.session import Workspace

SHARDS = 40
SOURCE_WEIGHTS = [3, 1, 2]
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), Workspace(spark), [1.0] * SHARDS)


def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_texts(table(spark, folder, "pages"))


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), Workspace(spark))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, folder, "documents"), Workspace(spark))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    rows = toxicity.with_toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    score = F.col("toxicity.score")
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), "toxicity.spans")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(table(spark, folder, "documents"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES)


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer_file())


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(table(spark, folder, "documents"), Workspace(spark), SOURCE_WEIGHTS)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"), Workspace(spark))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_components(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_sharding": op2_sharding,
        "op3_html": op3_html,
        "op4_topk": op4_topk,
        "op5_pii": op5_pii,
        "op6_ngram_join": op6_ngram_join,
        "op7_toxicity": op7_toxicity,
        "op8_secrets": op8_secrets,
        "op9_url_filter": op9_url_filter,
        "op10_bpe": op10_bpe,
        "op11_mixing": op11_mixing,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_whitening": op13_whitening,
    }


TOPK_SQL = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), numbered as (select *, row_number() over () as uid from rows),
scored as (
  select q.uid as query, q.vec_id as query_id, c.vec_id, c.uid,
         cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from numbered q join numbered c on c.uid <> q.uid and len(c.v) = len(q.v)
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query order by score desc, vec_id, uid) as rank from scored)
where rank <= 5
"""


# CRC-32 byte by byte over a table that the polynomial's rule gives.
SHARDING_SQL = """
with crc_table as (
  select list(c order by b) as steps from (
    select b, list_reduce(list_concat([b], range(8)), lambda a, i: case when a % 2 = 1 then xor(3988292384::bigint, a // 2) else a // 2 end) as c
    from (select unnest(range(256)) as b))
), rows as (
  select doc_id, encode(coalesce(text, '')) as raw, coalesce('k' || cast(doc_id as varchar), 'null') as k from documents
), coded as (
  select doc_id, k, cast(octet_length(raw) + 16 as bigint) as size,
         list_transform(range(1, octet_length(raw) + 1), lambda i: cast('0x' || substr(x, 2 * i - 1, 2) as bigint)) as bytes
  from (select *, hex(raw) as x from rows)
), scored as (
  select doc_id, size, cast('0x' || substr(md5(k), 1, 13) as bigint) as place,
         case when len(bytes) = 0 then 0 else xor(4294967295::bigint,
           list_reduce(list_concat([4294967295::bigint], bytes), lambda a, b: xor(a // 256, steps[xor(a, b) % 256 + 1]))) end as text_crc32,
         list_transform(range({shards} + 1), lambda s: {{'score': 1.0e0 / -ln((cast('0x' || substr(md5(k || ':' || cast(s as varchar)), 1, 13) as bigint) + 0.5e0) / 4503599627370496e0), 'shard': -s}}) as ranks
  from coded, crc_table
), placed as (
  select doc_id, size, cast(text_crc32 as bigint) as text_crc32, place, cast(-list_max(ranks[1:{shards}]).shard as integer) as shard, cast(-list_max(ranks).shard as integer) as grown_shard
  from scored
)
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard,
       row_number() over (partition by shard order by place, doc_id nulls first, size, text_crc32) - 1 as slot
from placed
""".format(shards=SHARDS)


# Pairs that share a shingle, their overlap, and all that links reach.
NGRAM_JOIN_SQL = """
with recursive rows as (
  select row_number() over () as r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
  from documents
), sets as (
  select r, doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from rows
), classes as (
  select min(r) as c, list_sort(s) as s, len(s) as n from sets where len(s) > 0 group by list_sort(s), len(s)
), members as (
  select sets.r, c from sets join classes on list_sort(sets.s) = classes.s
), tokens as (
  select c, n, unnest(s) as t from classes
), links as (
  select a.c as a, b.c as b from tokens a join tokens b on a.t = b.t and a.c <> b.c
       and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
  select c as a, c as b from classes
  union
  select reach.a, links.b from reach join links on links.a = reach.b
), least_id as (
  select reach.a as c, min(doc_id) as component_id from reach join members on members.c = reach.b join sets using (r) group by reach.a
)
select doc_id, cast(len(s) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id
from sets left join members using (r) left join least_id using (c)
"""


# With one source a document, the flow into a source is its quota, and the line of a source is cut there.
MIXING_SQL = """
with rows as (
  select doc_id, coalesce('k' || source, 'null') as key,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as size,
         cast('0x' || substr(md5('0:' || coalesce('k' || cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) as bigint) as place
  from documents
), sources as (
  select key, cast(sum(size) as bigint) as source_size, cast([3, 1, 2][cast((row_number() over (order by key) - 1) % 3 as bigint) + 1] as bigint) as weight from rows group by key
), ranked as (
  select *, 1.5e0 * sum(source_size) over () - coalesce(sum(2 * source_size) over before, 0) as words_left,
         sum(weight) over () - coalesce(sum(weight) over before, 0) as weight_left
  from sources window before as (order by 2e0 * source_size / weight, key rows between unbounded preceding and 1 preceding)
), capped as (
  select *, 2 * source_size <= words_left / weight_left * weight as full_up from ranked
), targets as (
  select key, source_size, cast(case when full_up then 2 * source_size else (select max(words_left / weight_left) filter (weight_left = w) from capped, (select max(weight_left) as w from capped where not full_up)) * weight end as double) as target from capped
), line as (
  select *, coalesce(sum(size) over (partition by key order by place, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as first,
         sum(size) over (partition by key) as n
  from rows
)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(greatest(0, least(floor(target + 0.5e0) - first, size)) + greatest(0, least(floor(target + 0.5e0) - n - first, size)) as bigint) as taken
from line join targets using (key)
"""


PREFIX_TRIE_SQL = """
with crc_table as (
  select list(c order by b) as steps from (
    select b, list_reduce(list_concat([b], range(8)), lambda a, i: case when a % 2 = 1 then xor(3988292384::bigint, a // 2) else a // 2 end) as c
    from (select unnest(range(256)) as b))
), rows as (
  select conv_id, turn, coalesce(text, '') as t, coalesce(role, '') as r from conversations where conv_id is not null
), turns as (
  select conv_id, turn, substr(sha256(cast(octet_length(encode(r)) as varchar) || ':' || r || t), 1, 32) as d,
         len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as w
  from rows
), own as (
  select conv_id, list(d order by turn nulls first, d) as ds, list(w order by turn nulls first, d) as ws from turns group by conv_id
), coded as (
  select *, xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
         lambda a, b: xor(a // 256, steps[xor(a, b) % 256 + 1]))) % 4 as h
  from own, crc_table
), paths as (
  select c.conv_id, list_concat(coalesce(b.ds[1:c.h], []), c.ds[c.h + 1:]) as ds, list_concat(coalesce(b.ws[1:c.h], []), c.ws[c.h + 1:]) as ws
  from coded c left join own b on b.conv_id = c.conv_id - c.conv_id % 20
), members as (
  select conv_id, unnest(range(0, len(ds) + 1)) as d, ds, ws from paths
), nodes as (
  select array_to_string(ds[1:d], '') as k, d, min(conv_id) as conv_id, count(*) as n, coalesce(min(ws[d]), 0) as w,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(ds) = d), '')) as ends
  from members group by 1, 2
), children as (
  select substr(k, 1, 32 * (d - 1)) as k, count(*) as n_children from nodes where d > 0 group by 1
), below as (
  select substr(n.k, 1, 32 * j) as k, count(*) filter (n_children is null) as n_leaves, sum((n - 1) * w) as saved
  from (select nodes.*, n_children, unnest(range(0, d + 1)) as j from nodes left join children using (k)) n group by 1
)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves,
       cast(b.saved as bigint) as saved_tokens, n.ends as ends_sha256
from nodes n left join nodes p on n.d > 0 and p.k = substr(n.k, 1, 32 * (n.d - 1)) left join children c on c.k = n.k join below b on b.k = n.k
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": SHARDING_SQL, "op4_topk": TOPK_SQL, "op6_ngram_join": NGRAM_JOIN_SQL, "op11_mixing": MIXING_SQL, "op12_prefix_trie": PREFIX_TRIE_SQL}
