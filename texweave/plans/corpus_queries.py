"""Profiles, filters, caps, samples and duplicates over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, joins, profiles, sampling
from ..sources import readers
from ..sources.readers import table
from .registry import query
from .views import LATEX_SQL, latex

_ASPECT = "cast(w as double) / greatest(h, 1)"
_REASON = rf"""case when length(trim(latex)) < 5 then 'short'
  when length(latex) - length(replace(latex, '{{', '')) <> length(latex) - length(replace(latex, '}}', '')) then 'unbal_brace'
  when {_ASPECT} > 20 then 'extreme_aspect' end"""


def _reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latex(spark, sf_dir)
    return rows.withColumn("reason", filters.drop_reason(F.col("latex"), F.col("w") / F.greatest("h", F.lit(1))))


@query("""select source, count(n_chars) as n_chars_count, avg(n_chars) as n_chars_mean, stddev_samp(n_chars) as n_chars_std,
  min(n_chars) as n_chars_min, max(n_chars) as n_chars_max, quantile_cont(n_chars, 0.25) as n_chars_p25,
  quantile_cont(n_chars, 0.5) as n_chars_p50, quantile_cont(n_chars, 0.75) as n_chars_p75 from documents group by source""")
def profile_by_source(spark, sf_dir):
    return profiles.describe(table(spark, sf_dir, "documents"), ["source"], ["n_chars"])


@query(r"""select event_type, count(value) as value_count, avg(value) as value_mean, stddev_samp(value) as value_std,
  min(value) as value_min, max(value) as value_max, quantile_cont(value, 0.25) as value_p25, quantile_cont(value, 0.5) as value_p50,
  quantile_cont(value, 0.75) as value_p75 from events group by event_type""")
def profile_events(spark, sf_dir):
    return profiles.describe(table(spark, sf_dir, "events"), ["event_type"], ["value"])


@query("""select source, count(*) as n, count(*) filter (length(text) > 5000) as long_text,
  count(*) filter (contains(text, chr(10))) as multi_line, count(*) filter (regexp_matches(text, '[0-9]')) as has_digits
  from documents group by source""")
def conditional_counts(spark, sf_dir):
    text = F.col("text")
    flags = {"long_text": F.length(text) > 5000, "multi_line": F.contains(text, F.lit("\n")), "has_digits": F.rlike(text, F.lit("[0-9]"))}
    return profiles.count_flags(table(spark, sf_dir, "documents"), ["source"], flags)


@query("select source, count(*) as n from documents group by source")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query(f"select idx, source, {_REASON} as reason from {LATEX_SQL}")
def filter_reasons(spark, sf_dir):
    return _reasoned(spark, sf_dir).select("idx", "source", "reason")


@query(f"""select source, reason, count(*) as n, cast(grouping(source) * 2 + grouping(reason) as bigint) as level
  from (select source, {_REASON} as reason from {LATEX_SQL}) group by rollup (source, reason)""")
def filter_reason_rollup(spark, sf_dir):
    return filters.reason_rollup(_reasoned(spark, sf_dir), "source", "reason")


@query(r"""with t as (select doc_id, source, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as s from documents),
  r as (select source, case when length(s) = 0 then 'blank' when length(s) < 3 then 'short' when length(s) > 400 then 'long' end as reason from t)
  select source, coalesce(reason, 'kept') as reason, count(*) as n from r group by 1, 2""")
def filter_length(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.coalesce(filters.length_reason(F.col("text")), F.lit("kept")).alias("reason"))
    return rows.groupBy("source", "reason").agg(F.count("*").alias("n"))


@query(f"""select idx, latex, row_number() over (order by idx) - 1 as place from (select idx, latex, row_number() over
  (partition by trim(latex) order by idx) as r from {LATEX_SQL} where length(trim(latex)) between 3 and 400) where r <= 3""")
def filter_length_cap(spark, sf_dir):
    rows = latex(spark, sf_dir).where(filters.length_reason(F.col("latex")).isNull()).select("idx", "latex")
    return filters.dense_index(filters.cap_per_key(rows, T.stripped(F.col("latex")), ["idx"], 3), ["idx"], "place")


@query("select lang, count(*) as n, count(*) - count(distinct text) as dup_text from documents group by lang")
def dup_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dup = profiles.duplicates(docs, ["lang"], {"dup_text": F.col("text")})
    return docs.groupBy("lang").agg(F.count("*").alias("n")).join(dup, "lang")


@query("select source, count(*) - count(distinct md5(text)) as dup_md5 from documents group by source")
def dup_md5(spark, sf_dir):
    return profiles.duplicates(table(spark, sf_dir, "documents"), ["source"], {"dup_md5": F.md5(F.col("text").cast("binary"))})


@query("select md5(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def dup_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest"))
    return rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""select page_id, length(html) - length(replace(html, '{', '')) as opened, length(html) - length(replace(html, '}', '')) as closed,
  opened = closed as balanced from pages""")
def brace_balance(spark, sf_dir):
    html = F.col("html")
    opened, closed = (F.regexp_count(html, F.lit(x)).cast("long") for x in (r"\{", r"\}"))
    return table(spark, sf_dir, "pages").select("page_id", opened.alias("opened"), closed.alias("closed"), T.braces_balanced(html).alias("balanced"))


@query("""with q as (select quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from events),
  b as (select case when hi > lo then least(cast(floor((greatest(lo, least(hi, value)) - lo) / ((hi - lo) / 60)) as bigint), 59) else 0 end as bin,
               (hi - lo) / 60 as width from events, q where value is not null)
  select bin, count(*) as n, count(*)::double / sum(count(*)) over () / any_value(width) as density from b group by bin""")
def histogram_60(spark, sf_dir):
    return profiles.histogram(table(spark, sf_dir, "events"), "value")


@query("""with b as (select case when value >= 0 and value < 5 then 0 when value >= 5 and value < 15 then 1
  when value >= 15 and value < 30 then 2 when value >= 30 and value < 999 then 3 end as bucket from events)
  select bucket, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as pct from b where bucket is not null group by bucket""")
def value_buckets(spark, sf_dir):
    return profiles.buckets(table(spark, sf_dir, "events"), "value", [0, 5, 15, 30, 999])


@query("select source as value, count(*) as n from documents group by source order by n desc, value limit 10")
def topk_sources(spark, sf_dir):
    return profiles.top_k(table(spark, sf_dir, "documents"), "source", 10)


@query(f"select trim(latex) as value, count(*) as n from {LATEX_SQL} where length(trim(latex)) < 10 group by 1 order by n desc, value limit 30")
def topk_short(spark, sf_dir):
    text = T.stripped(F.col("latex"))
    return profiles.top_k(latex(spark, sf_dir).where(F.length(text) < 10), text, 30)


@query(f"""select idx, unnest(list_filter([case when length(trim(latex)) < 5 then 'short_latex' end,
  case when {_ASPECT} > 20 then 'extreme_aspect' end], lambda x: x is not null)) as issue from {LATEX_SQL}""")
def edge_cases(spark, sf_dir):
    return latex(spark, sf_dir).select("idx", F.explode(filters.all_issues(F.col("latex"), F.col("w") / F.greatest("h", F.lit(1)))).alias("issue"))


@query(f"""select idx, {_ASPECT} as aspect from {LATEX_SQL} order by aspect desc, idx limit 20""")
def worst_aspect(spark, sf_dir):
    return latex(spark, sf_dir).select("idx", (F.col("w") / F.greatest("h", F.lit(1))).alias("aspect")).orderBy(F.desc("aspect"), "idx").limit(20)


@query("""select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5(doc_id || ':42'), doc_id) as r
  from documents) where r <= 5""")
def sample_per_group(spark, sf_dir):
    return sampling.per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("""with s as (select doc_id, source, case when toxic is null then 'easy' when toxic = 0 then 'medium' else 'hard' end as klass
    from documents left join labels using (doc_id)),
  r as (select *, row_number() over (partition by source, klass = 'easy' order by md5(doc_id || ':42'), doc_id) as k,
               count(*) over (partition by source, klass = 'easy') as n from s)
  select doc_id, source, klass from r where klass <> 'easy' or k <= round_even(n * 0.3, 0)""")
def curriculum_filter(spark, sf_dir):
    score = F.when(F.col("toxic").isNull(), 0.0).when(F.col("toxic") == 0, 0.05).otherwise(0.5)
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", "source", filters.score_class(score).alias("klass"))
    return sampling.share_of_class(rows, "source", "doc_id", F.col("klass") == "easy", 0.3)


@query("""with f as (select source, row_number() over (order by md5(source || ':42'), source) as r, count(*) over () as n
    from (select distinct source from documents)),
  k as (select source, r, greatest(round_even(n * 0.5, 0), 1) as n from f)
  select doc_id, case when r <= least(3, n - 1) then 'validation' else 'train' end as split from documents join k using (source) where r <= n""")
def file_split(spark, sf_dir):
    return sampling.file_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 3, 0.5).select("doc_id", "split")


@query("""select doc_id, cast(floor((row_number() over (order by doc_id) - 1) / 100.0) as bigint) as shard,
  row_number() over (order by doc_id) - 1 as idx from documents""")
def shard_assign(spark, sf_dir):
    rows = filters.dense_index(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return rows.select("doc_id", filters.shard_number(F.col("idx"), 100).alias("shard"), "idx")


@query("""select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) where i % 4 = 1""")
def worker_shard(spark, sf_dir):
    rows = filters.dense_index(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return rows.where(filters.worker_slice(F.col("idx"), 4, 1)).select("doc_id")


@query("""select d.doc_id, l.quality, l.doc_id is not null as found from documents d left join labels l using (doc_id)""")
def stem_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.col("doc_id").alias("_order"))
    return joins.stem_join(table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id", "_order").select("doc_id", "quality", "found")


@query("""select 'present' as kind, count(*) as n from documents where doc_id in (select doc_id from labels)
  union all select 'absent', count(*) from documents where doc_id not in (select doc_id from labels)""")
def missing_semi(spark, sf_dir):
    there, gone = joins.present(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    count = lambda rows, kind: rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(there, "present").unionByName(count(gone, "absent"))


@query("""select doc_id, 'missing' as side from documents where doc_id not in (select page_id from pages)
  union select page_id, 'extra' from pages where page_id not in (select doc_id from documents)""")
def key_differences(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return joins.key_differences(table(spark, sf_dir, "documents").select("doc_id"), pages, "doc_id")


@query("""select lang, n, long_text, multi_line, 100.0 * (long_text + multi_line) / n as issue_rate,
  case when 100.0 * (long_text + multi_line) / n < 1 then 'GOOD' when 100.0 * (long_text + multi_line) / n < 5 then 'WARN' else 'BAD' end as grade
  from (select lang, count(*) as n, count(*) filter (length(text) > 5000) as long_text, count(*) filter (contains(text, chr(10))) as multi_line
        from documents group by lang)""")
def quality_grade(spark, sf_dir):
    text = F.col("text")
    counts = profiles.count_flags(table(spark, sf_dir, "documents"), ["lang"], {"long_text": F.length(text) > 5000, "multi_line": F.contains(text, F.lit("\n"))})
    return profiles.issue_grades(counts, ["long_text", "multi_line"])


@query("""select doc_id, case when length(text) > 60 then substr(text, 1, 60) || '…' else text end as shown from documents""")
def shortened_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.shortened(F.col("text"), 60).alias("shown"))


@query("""select doc_id, source, row_number() over (partition by source order by md5(doc_id || ':42'), doc_id) - 1 as place from documents""")
def shuffle_in_file(spark, sf_dir):
    return sampling.shuffled_within(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query(f"select count(distinct trim(latex)) as n_unique from {LATEX_SQL} where length(trim(latex)) between 3 and 400")
def unique_retained(spark, sf_dir):
    kept = latex(spark, sf_dir).where(filters.length_reason(F.col("latex")).isNull())
    return kept.agg(F.count_distinct(T.stripped(F.col("latex"))).alias("n_unique"))


@query("""with v as (select n_chars as v, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from documents)
  select 'p' || k as name, max(v) filter (i = least(floor(n * k / 100.0), n - 1)) as value from v, unnest([50, 95, 99]) t(k) group by k""")
def tok_len_stats(spark, sf_dir):
    return profiles.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", [0.5, 0.95, 0.99])


@query("""select doc_id, (2 * row_number() over (partition by source order by doc_id) - 1) / 2.0 / case source when 'src0' then 3.0 when 'src1' then 2.0 else 1.0 end as place
  from documents""")
def interleave_weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.interleave(rows, "source", ["doc_id"], {"src0": 3, "src1": 2, "src2": 1}).select("doc_id", "place")


@query("""with r as (select doc_id, source, case source when 'src0' then 3.0 when 'src1' then 2.0 else 1.0 end as w,
    row_number() over (partition by source order by doc_id) as k from documents)
  select doc_id from r where (k - 0.5) / w < (select min(e) from (select max((k - 0.5) / w + 0.5 / w) as e from r group by source))""")
def interleave_first_exhausted(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.interleave(rows, "source", ["doc_id"], {"src0": 3, "src1": 2, "src2": 1}, until="first").select("doc_id")


@query("""with k as (select doc_id, (md5_number_upper(doc_id || ':42'))::hugeint as m from documents),
  u as (select doc_id, cast(('0x' || substr(md5(doc_id || ':42'), 1, 8)) as bigint) / 4294967296.0 as u from k)
  select doc_id, case when u < 0.5 then 'serif' when u < 0.8 then 'sans' else 'mono' end as font from u""")
def weighted_choice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sampling.weighted_choice(F.col("doc_id"), [("serif", 5), ("sans", 3), ("mono", 2)]).alias("font"))


@query("""select cast(floor(i / 32.0) as bigint) as batch, list(doc_id order by i) as keys
  from (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) group by 1 having count(*) = 32""")
def minibatch(spark, sf_dir):
    return sampling.minibatches(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "doc_id", 32, drop_last=True)


@query("""with c as (select item_id, md5(item_id || ':42') as m from benchmark order by m, item_id limit 1000),
  p as (select item_id, row_number() over (order by m, item_id) - 1 as i, count(*) over () as n from c)
  select item_id, cast(i + tile * n as bigint) as place from p, range(0, 1000) t(tile) where i + tile * n < 1000""")
def sample_tiled(spark, sf_dir):
    rows = sampling.exactly(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 1000)
    from pyspark.sql import Window as W

    n = table(spark, sf_dir, "benchmark").count()
    order = W.orderBy(sampling.keyed(F.col("item_id")), "item_id")
    tile = F.row_number().over(W.partitionBy("item_id").orderBy(F.lit(0))) - 1
    return rows.select("item_id", (F.dense_rank().over(order) - 1 + tile * n).cast("bigint").alias("place"))


@query("""select source, n, format('{:,}  ({:.2f}%)', n, 100.0 * n / sum(n) over ()) as share from (select source, count(*) as n from documents group by source)""")
def count_report(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("source", "n", T.counted_share(F.col("n"), F.col("total")).alias("share"))  # one row


@query("select 'documents' as dataset, count(*) as n from documents union all select 'pages', count(*) from pages")
def row_counts(spark, sf_dir):
    """From the footers of the files alone."""
    counts = [readers.row_counts(spark, f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("dataset"), "n") for t in ("documents", "pages")]
    return counts[0].unionByName(counts[1])


@query("""select coalesce(lang, 'all') as lang, count(distinct text) as n_texts, true as close from documents group by rollup (lang)""")
def distinct_sketches(spark, sf_dir):
    """Distinct texts by language and, by the union of the same sketches, in all: within 5 % of the exact number."""
    rows = table(spark, sf_dir, "documents").select("lang", "text")
    sketches = profiles.distinct_sketches(rows, ["lang"], "text")
    every = profiles.united(sketches, [], "text").withColumn("lang", F.lit("all"))
    found = profiles.united(sketches, ["lang"], "text").unionByName(every)
    exact = rows.rollup("lang").agg(F.count_distinct("text").alias("n_texts")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "n_texts")
    return exact.join(found, "lang").select("lang", "n_texts", (F.abs(F.col("text_distinct") - F.col("n_texts")) <= 0.05 * F.col("n_texts")).alias("close"))
