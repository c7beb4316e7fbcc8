"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, divergence, html, mixing, neighbours, pii, quality, sharding, simhash, toxicity, trie, urls
from .common import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(read_table(spark, sf_dir, "conversations"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.drop("passages")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(read_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A public key, for a query whose results can be compared; whoever hides data passes a secret one.
    return pii.pseudonymize(read_table(spark, sf_dir, "documents"), b"op10_pii")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicate_embeddings(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_decontaminate, op3_chat, op4_html, op5_simhash, op6_toxicity, op7_quality, op8_sharding, op9_urls, op10_pii,
        op11_trie, op12_divergence, op13_neighbours,
    )
}

_OP2 = r"""
with b as (select coalesce(cast(item_id as varchar), 'null') as item,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select item, least(10, len(w)) as k, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0),
win as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as g from bw),
d as (select row_number() over () as r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
ks as (select distinct k from win),
dw as (select r, k, w, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k),
hit as (select r, i, dw.k, item from dw join win on win.k = dw.k and win.g = array_to_string(w[i:i + dw.k - 1], ' ')),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hit) group by r),
its as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (r) left join its using (r)
"""

_OP7 = r"""
with d as (select row_number() over () as r, doc_id, coalesce(source, chr(1)) as host, coalesce(text, '') as t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select r, host, t, unnest(string_split(t, chr(10))) as line from d),
n as (select r, host, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as size,
             array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
                                                '[^\x20\x09-\x0D]+'), ' ') as norm from l),
f as (select * from n where size > 0),
heavy as (select host, norm from f group by host, norm having count(distinct t) >= 5),
lost as (select r, sum(size) as boiler from f join heavy using (host, norm) group by r),
dup as (select r, count(*) - count(distinct line) as n from f group by r),
g as (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8),
again as (select r, unnest(i) as i from (select r, list(i) as i from g group by r, array_to_string(w[i:i + 7], ' ') having count(*) > 1)),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from again) group by r),
m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
             coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(boiler, 0) as boiler
      from d left join dup using (r) left join rep using (r) left join lost using (r)),
v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words - boiler >= 0.5 * n_words as kept, cast(boiler as bigint) as boiler_words
from v
"""

_OP8 = r"""
with recursive step(i, k, c) as (
  select i, 0, cast(i as bigint) from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
tab as (select list(c order by i) as z from step where k = 8),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, octet_length(encode(coalesce(text, ''))) + 16 as size from documents),
u as (select d.t, list_reduce(list_prepend(cast(4294967295 as bigint),
                 list_transform(range(1, 2 * octet_length(encode(d.t)), 2), lambda i: cast(('0x' || substr(hex(encode(d.t)), i, 2)) as bigint))),
                 lambda a, b: xor(a >> 8, tab.z[(xor(a, b) & 255) + 1])) as c
      from (select distinct t from d) d, tab),
k as (select r, doc_id, size, xor(c, 4294967295) as crc,
             ((cast(('0x' || substr(md5(d.t), 1, 10)) as bigint) >> 1) << 24)
             | (cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 10)) as bigint) >> 16) as key
      from d join u on u.t = d.t),
below as (select key, coalesce(sum(sum(size)) over (order by key rows between unbounded preceding and 1 preceding), 0) as b,
                 (select sum(size) from k) as total from k group by key),
first as (select i, min(key) as key, any_value(total) as total from below, range(1, 40) s(i) where b >= ceil(total * i / 40.0) group by i),
whole as (select i, first.key, total, sum(size) as every, coalesce(sum(size) filter (k.key < first.key), 0) as before
          from first join k on k.key >> 24 = first.key >> 24 group by i, first.key, total),
cut as (select i, case when every * 40 > total then key when 2 * before <= every then (key >> 24) << 24 else ((key >> 24) + 1) << 24 end as key from whole),
p as (select k.*, (select count(*) from cut where cut.key <= k.key) as shard from k)
select doc_id, size, crc as text_crc32, 'bytes' as law, cast(shard as integer) as shard,
       row_number() over (partition by shard order by key, doc_id, size, crc) - 1 as slot, cast(null as integer) as grown_shard
from p
"""

ORACLES: dict[str, str] = {
    "op2_decontaminate": _OP2, "op3_chat": chat.ORACLE_SQL, "op7_quality": _OP7, "op8_sharding": _OP8,
    "op11_trie": trie.ORACLE_SQL, "op12_divergence": divergence.ORACLE_SQL,
}
