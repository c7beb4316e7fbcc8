"""Markup statistics, lexing, vocabularies and subwords over the derived samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, text as T
from ..operators import joins, profiles, subwords
from ..sources.readers import table
from .registry import query
from .views import LATEX_SQL, latex, spread_latex

_TOKENS = rf"""(select idx, unnest(range(0, len(t))) as pos, unnest(t) as raw from (select idx, regexp_extract_all(
  regexp_replace(latex, '(\\(?:begin|end)\{{)pmatrix(\}})', '\1' || chr(1) || '\2', 'g'),
  '\\[a-zA-Z]+\*?|\\[^a-zA-Z\s]|[0-9]+\.?[0-9]*|\.[0-9]+|\s+|\S') as t from {LATEX_SQL}))"""
_TYPED = rf"""(select idx, pos, case when raw = chr(1) then 'pmatrix' when regexp_full_match(raw, '\s+') then ' ' else raw end as token,
  case when raw = chr(1) then 'ENV_NAME' when raw = '\\' then 'LINEBREAK' when regexp_matches(raw, '^\\[a-zA-Z]') then 'COMMAND'
    when raw = '{{' then 'LBRACE' when raw = '}}' then 'RBRACE' when raw = '^' then 'CARET' when raw = '_' then 'UNDERSCORE'
    when raw = '&' then 'AMPERSAND' when raw = '=' then 'EQUALS' when raw = '+' then 'PLUS' when raw = '-' then 'MINUS'
    when regexp_matches(raw, '^([0-9]|\.[0-9])') then 'NUMBER' when regexp_full_match(raw, '[a-zA-Z]') then 'LETTER'
    when regexp_full_match(raw, '\s+') then 'SPACE' else 'OTHER' end as ttype from {_TOKENS})"""
_ZONES = f"""(select idx, min(pos) as start, list(token order by pos) as units from (select *, sum(case when ttype in
  ('LETTER', 'GREEK_UC', 'GREEK_LC', 'OTHER') then 0 else 1 end) over (partition by idx order by pos) as island from {_TYPED})
  where ttype in ('LETTER', 'GREEK_UC', 'GREEK_LC', 'OTHER') group by idx, island)"""


@query(rf"""select idx, length(latex) as length, len(regexp_extract_all(latex, '\\[a-zA-Z]+')) as n_commands,
  len(list_distinct(regexp_extract_all(latex, '\\[a-zA-Z]+'))) as n_unique_cmds, len(regexp_extract_all(latex, '\\begin\{{([^}}]+)\}}', 1)) as n_envs,
  len(regexp_extract_all(latex, '\\frac')) as n_fracs, len(regexp_extract_all(latex, '[\^_]')) as n_sup_sub,
  regexp_matches(latex, '[0-9]') as has_numbers,
  length(latex) - length(replace(latex, '{{', '')) = length(latex) - length(replace(latex, '}}', '')) as brace_balanced,
  trim(latex) = '' as is_empty, contains(latex, chr(10)) or contains(latex, '\\') as has_newline from {LATEX_SQL}""")
def latex_stats(spark, sf_dir):
    return latex(spark, sf_dir).select("idx", *(c.alias(k) for k, c in T.statistics(F.col("latex")).items()))


@query(rf"""select source, count(length) as length_count, avg(length) as length_mean, stddev_samp(length) as length_std, min(length) as length_min,
  max(length) as length_max, quantile_cont(length, 0.25) as length_p25, quantile_cont(length, 0.5) as length_p50, quantile_cont(length, 0.75) as length_p75
  from (select source, length(latex) as length from {LATEX_SQL}) group by source""")
def latex_stats_summary(spark, sf_dir):
    return profiles.describe(latex(spark, sf_dir).select("source", F.length("latex").alias("length")), ["source"], ["length"])


@query(rf"""select cmd, count(*) as n from (select unnest(regexp_extract_all(latex, '\\[a-zA-Z]+')) as cmd from {LATEX_SQL}) group by cmd order by n desc, cmd limit 15""")
def top_commands(spark, sf_dir):
    return profiles.top_commands(latex(spark, sf_dir), "latex")


@query(rf"""with c as (select idx, unnest(t) as cmd, unnest(range(0, len(t))) as p from (select idx, regexp_extract_all(latex, '\\[a-zA-Z]+') as t from {LATEX_SQL})),
  k as (select idx, cmd, count(*) as n, row_number() over (partition by idx order by count(*) desc, min(p)) as r from c group by idx, cmd)
  select cmd, cast(sum(n) as bigint) as n from k where r <= 5 group by cmd order by n desc, cmd limit 15""")
def top_commands_per_row(spark, sf_dir):
    return profiles.top_commands(latex(spark, sf_dir), "latex", per_row=5)


@query(rf"""select source, count(*) filter (cmd = '\alpha') as alpha, count(*) filter (cmd = '\begin') as "begin", count(*) filter (cmd = '\end') as "end",
  count(*) filter (cmd = '\frac') as frac, count(*) filter (cmd = '\sqrt') as sqrt, count(*) filter (cmd = '\sum') as sum, count(*) filter (cmd = '\times') as times
  from (select source, unnest(regexp_extract_all(latex, '\\[a-zA-Z]+')) as cmd from {LATEX_SQL}) group by source""")
def command_pivot(spark, sf_dir):
    rows = latex(spark, sf_dir)
    top = sorted(r.cmd[1:] for r in profiles.top_commands(rows, "latex").collect())  # 15 at most
    each = rows.select("source", F.explode(T.commands(F.col("latex"))).alias("cmd")).withColumn("cmd", F.expr("substring(cmd, 2)"))
    return each.groupBy("source").pivot("cmd", top).count().fillna(0)


@query(rf"select doc_id, len(regexp_extract_all(text, '\\[a-zA-Z]+|[^\s]')) as n_tokens, regexp_extract_all(text, '\\[a-zA-Z]+|[^\s]')[1:5] as head from documents")
def eval_tokens(spark, sf_dir):
    found = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_tokens"), F.slice(found, 1, 5).alias("head"))


@query(rf"""select idx, len(regexp_extract_all(latex, '\\[a-zA-Z]+|\\.|[0-9]|[a-zA-Z]|[^\s]')) as n_units from {LATEX_SQL}""")
def pre_tokens(spark, sf_dir):
    return latex(spark, sf_dir).select("idx", F.size(T.tokens(F.col("latex"), T.PRE_TOKEN)).alias("n_units"))


@query(rf"select idx, replace(latex, ' ', '') as joined, trim(trim('$' || latex || '$', '$')) as bare from {LATEX_SQL}")
def detokenized(spark, sf_dir):
    text = F.col("latex")
    wrapped = F.concat(F.lit("$"), text, F.lit("$"))
    return latex(spark, sf_dir).select("idx", T.without_spaces(text).alias("joined"), T.without_dollars(wrapped).alias("bare"))


@query(f"select idx, pos, token, ttype, ttype not in ('LETTER', 'GREEK_UC', 'GREEK_LC', 'OTHER') as frozen from {_TYPED}")
def lexer_tokens(spark, sf_dir):
    return markup.token_rows(spread_latex(spark, sf_dir), "idx", "latex")


@query(f"select ttype, count(*) as n from {_TYPED} group by ttype")
def token_type_counts(spark, sf_dir):
    return markup.token_rows(spread_latex(spark, sf_dir), "idx", "latex").groupBy("ttype").agg(F.count("*").alias("n"))


@query(f"select units, count(*) as freq from {_ZONES} group by units")
def bpe_zones(spark, sf_dir):
    return subwords.zone_counts(markup.zones(spread_latex(spark, sf_dir), "idx", "latex"))


@query(f"select token, count(*) as n from {_TYPED} where ttype = 'NUMBER' group by token having count(*) >= 2 order by n desc, token limit 32")
def number_freq(spark, sf_dir):
    return subwords.number_slots(subwords.token_counts(markup.token_rows(spread_latex(spark, sf_dir), "idx", "latex")), 128)


@query(rf"""with w as (select string_split_regex(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +') as w from benchmark),
  z as (select list_filter(string_split(unnest(w), ''), lambda c: c <> '') as units from w), c as (select units, count(*) as freq from z where len(units) > 0 group by units)
  select a, b, cast(sum(freq) as bigint) as n from (select freq, unnest(units[1:len(units) - 1]) as a, unnest(units[2:]) as b from c where len(units) > 1) group by a, b""")
def pair_freq(spark, sf_dir):
    return subwords.pair_counts(_word_zones(spark, sf_dir))


def _word_zones(spark, sf_dir):
    clean = F.regexp_replace(F.lower("text"), "[^a-z ]", " ")
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(clean, " +")).alias("w")).where("w <> ''")
    return subwords.zone_counts(words.select(F.filter(F.split("w", ""), lambda c: c != "").alias("units")))


@query()
def bpe_merges(spark, sf_dir):
    merges = subwords.learn_merges(_word_zones(spark, sf_dir), 64)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank int, a string, b string")


MERGES = 64


def _vocabulary(spark, sf_dir):
    rows = spread_latex(spark, sf_dir)
    counted, zones = subwords.corpus_counts(rows, "latex")
    commands = [r.token for r in subwords.frequent_commands(counted).collect()]  # at most 512
    numbers = [r.token for r in subwords.number_slots(counted, 256).collect()]
    merges = subwords.learn_merges(zones, MERGES)
    return rows, subwords.extend(subwords.base_tokens(commands), numbers, merges, 2048)


@query()
def encode_ids(spark, sf_dir):
    rows, vocabulary = _vocabulary(spark, sf_dir)
    return subwords.encode(rows, "idx", "latex", vocabulary, most=200)


def _pieces(spark, sf_dir):
    rows = spread_latex(spark, sf_dir)
    counted = subwords.piece_counts(rows, "latex").cache()
    vocabulary = subwords.piece_vocabulary(counted)
    counted.unpersist()
    return rows, vocabulary


@query()
def piece_ids(spark, sf_dir):
    """Ids by the second trainer: 8,192 at most, merges inside tokens."""
    rows, vocabulary = _pieces(spark, sf_dir)
    return subwords.encode_pieces(rows, "idx", "latex", vocabulary)


@query(rf"select idx, array_to_string(regexp_extract_all(latex, '\\[a-zA-Z]+|\\.|[0-9]|[a-zA-Z]|[^\s]'), '') as back from {LATEX_SQL}")
def piece_roundtrip(spark, sf_dir):
    rows, vocabulary = _pieces(spark, sf_dir)
    return subwords.encode_pieces(rows, "idx", "latex", vocabulary).select("idx", subwords.decode(F.col("ids"), vocabulary).alias("back"))


@query(f"select idx, latex as back from {LATEX_SQL}")
def decode_roundtrip(spark, sf_dir):
    rows, vocabulary = _vocabulary(spark, sf_dir)
    return subwords.encode(rows, "idx", "latex", vocabulary).select("idx", subwords.decode(F.col("ids"), vocabulary).alias("back"))


@query(rf"select idx, regexp_extract_all(latex, '\\begin|\\frac|\\sum|\\sqrt|pmatrix|10|[\s\S]') as parts from {LATEX_SQL}")
def longest_match(spark, sf_dir):
    tokens = ["\\begin", "\\frac", "\\sum", "\\sqrt", "pmatrix", "10", "1", "\\"]
    return spread_latex(spark, sf_dir).select("idx", subwords.longest_match(F.col("latex"), tokens).alias("parts"))


@query(rf"""with t as materialized {_TYPED}, v as (select token, cast(3 + row_number() over (order by n desc, token) as integer) as id
    from (select token, count(*) as n from t group by token having count(*) > 5 order by n desc, token limit 2044))
  select idx, pos, coalesce(id, 1) as id from t left join v using (token)""")
def vocab_lookup(spark, sf_dir):
    """A vocabulary of the corpus' own frequent tokens; rarer ones are unknown."""
    typed = markup.token_rows(spread_latex(spark, sf_dir), "idx", "latex")
    frequent = profiles.top_k(typed, "token", 2044, "token").where("n > 5").collect()  # a vocabulary
    vocabulary = spark.createDataFrame([(r.token, 4 + k) for k, r in enumerate(frequent)], "token string, id int")
    return joins.lookup_ids(typed, "token", vocabulary).select("idx", "pos", "id")


@query(rf"""with t as (select text, regexp_extract_all(text, '\\[a-zA-Z]+|\\.|[0-9]|[a-zA-Z]|[^\s]') as t from documents),
  r as (select length(text) / greatest(len(t), 1.0) as ratio, len(t) as n, len(list_filter(t, lambda x: not regexp_full_match(x, '[ -~]'))) as unk from t)
  select avg(ratio) as ratio_mean, stddev_samp(ratio) as ratio_std, quantile_cont(ratio, 0.5) as ratio_median, sum(unk) / sum(n) as unk_rate,
         avg((unk > 0)::int) as unk_share, avg(n) as tokens_per_text from r""")
def compression_stats(spark, sf_dir):
    return subwords.compression(_plain_ids(spark, sf_dir), "text", "ids")


def _plain_ids(spark, sf_dir):
    """text and ids: units before merges, with the code of printable ASCII characters as ids and all others unknown."""
    ids = F.transform(T.tokens(F.col("text"), T.PRE_TOKEN), lambda t: F.when(F.rlike(t, F.lit("^[ -~]$")), F.ascii(t)).otherwise(subwords.UNK))
    return table(spark, sf_dir, "documents").select("text", ids.alias("ids"))


@query(rf"""with t as (select regexp_extract_all(text, '\\[a-zA-Z]+|\\.|[0-9]|[a-zA-Z]|[^\s]') as t from documents),
  s as (select len(t) as n, len(list_filter(t, lambda x: not regexp_full_match(x, '[ -~]'))) as unk, row_number() over (order by len(t)) - 1 as i, count(*) over () as c from t)
  select count(*) as n, min(n) as shortest, avg(n) as mean, max(n) as longest, sum(unk) / sum(n) as unk_rate, max(n) filter (i = least(floor(c * 0.5), c - 1)) as p50,
         max(n) filter (i = least(floor(c * 0.95), c - 1)) as p95, max(n) filter (i = least(floor(c * 0.99), c - 1)) as p99 from s""")
def token_length_summary(spark, sf_dir):
    return profiles.length_summary(_plain_ids(spark, sf_dir), "ids", subwords.UNK)


@query(rf"""with r as (select regexp_extract_all(latex, '\\[a-zA-Z]+') as c, regexp_extract_all(latex, '\\begin|\\frac|\\sq|\\sum|pmatrix|10|[\s\S]') as p from {LATEX_SQL}),
  e as (select unnest(list_distinct(c)) as cmd, c, p from r), k as (select cmd, len(list_filter(c, lambda x: x = cmd)) as n, len(list_filter(p, lambda x: x = cmd)) as kept from e)
  select cmd, cast(sum(n) as bigint) as n, sum(least(n, kept)) / sum(n) as intact from k group by cmd""")
def command_intact(spark, sf_dir):
    parts = subwords.longest_match(F.col("latex"), ["\\begin", "\\frac", "\\sq", "\\sum", "pmatrix", "10"])
    rows = spread_latex(spark, sf_dir).select(T.commands(F.col("latex")).alias("commands"), parts.alias("parts"))
    return subwords.intact_rates(rows, "commands", "parts")


@query(rf"""with e as (select p_partkey as idx, unnest(regexp_extract_all(t, '\\begin\{{([a-z]+)', 1)) as item, unnest(range(1, 20)) as i from
    (select p_partkey, concat('\begin{{', lower(substr(p_brand, 1, 3)), '}} ', repeat('\begin{{a}} ', p_size % 3), repeat('\begin{{b}} ', p_size % 4), repeat('\begin{{c}} ', p_size % 2)) as t from part)),
  c as (select idx, item, count(*) as n, min(i) as pos from e where item is not null group by 1, 2),
  r as (select *, row_number() over (partition by idx order by n desc, pos) as rank from c)
  select idx, cast(rank as integer) as rank, item, cast(n as integer) as n from r where rank <= 3""")
def top_environments_per_row(spark, sf_dir):
    """The three most frequent environments of a text, ties by first appearance."""
    times = lambda name, k: F.expr(rf"repeat(r'\begin{{{name}}} ', cast(p_size % {k} as int))")
    first = F.concat(F.lit("\\begin{"), F.lower(F.substring("p_brand", 1, 3)), F.lit("} "))
    text = F.concat(first, times("a", 3), times("b", 4), times("c", 2))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), T.most_common(T.environments(text), 3).alias("top"))
    return rows.select("idx", F.posexplode("top").alias("at", "e")).select("idx", (F.col("at") + 1).alias("rank"), "e.item", "e.n")


_FREQUENT = r"""f as (select w, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Za-z]+|[0-9]+')) as w from documents) where length(w) between 2 and 20
    group by w order by n desc, w limit 2048), pat as (select string_agg(w, '|' order by length(w) desc, w) || '|[\s\S]' as p from f)"""


def _frequent(spark, sf_dir):
    """A vocabulary of 2,048 tokens out of the corpus: its most frequent words and numbers."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))).alias("w")).where(F.length("w").between(2, 20))
    return [r.value for r in profiles.top_k(words, "w", 2048).collect()]  # a vocabulary


@query(rf"""with {_FREQUENT}, r as (select doc_id, regexp_extract_all(text, (select p from pat)) as parts from documents)
  select doc_id, cast(len(parts) as bigint) as n_parts, md5(array_to_string(parts, chr(1))) as parts_md5 from r""")
def longest_match_corpus(spark, sf_dir):
    parts = subwords.longest_match(F.col("text"), _frequent(spark, sf_dir))
    rows = table(spark, sf_dir, "documents").select("doc_id", parts.alias("parts"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n_parts"), F.md5(F.array_join("parts", "\x01")).alias("parts_md5"))


_LETTERS = r"""f as (select w from (select unnest(regexp_extract_all(latex, '\\?[a-z]{{2}}|[0-9]+')) as w from {view}) group by w having count(*) > 1), pat as (select string_agg(
    regexp_escape(w), '|' order by length(w) desc, w) || '|[\s\S]' as p from f)"""


@query(rf"""with {_LETTERS.format(view=LATEX_SQL)}, r as (select idx, latex, regexp_extract_all(latex, (select p from pat)) as parts from {LATEX_SQL}),
  p as (select idx, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as i from r),
  o as (select idx, part, i, sum(length(part)) over (partition by idx order by i) as b from p),
  g as (select idx, latex, regexp_extract_all(latex, '\\[a-zA-Z]+') as c, regexp_split_to_array(latex, '\\[a-zA-Z]+') as gap from r),
  e as (select idx, unnest(c) as cmd, unnest(range(1, len(c) + 1)) as k, gap, c from g),
  s as (select idx, k, cmd, list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(c[1:k - 1], lambda x: length(x))), 0) as a from e),
  x as (select s.idx, s.k, s.cmd, string_agg(part, ' |' order by i) as broken, count(*) = 1 and max(part) = s.cmd as whole
        from s join o on o.idx = s.idx and o.b > s.a and o.b - length(part) < s.a + length(s.cmd) group by 1, 2, 3),
  n as (select cmd, case when not whole then broken end as broken, count(*) as k from x group by 1, 2),
  q as (select *, row_number() over (partition by cmd order by broken is null, k desc, broken) as r from n)
  select cmd, cast(sum(k) as bigint) as n, coalesce(sum(k) filter (broken is null), 0) / sum(k) as intact,
         coalesce(list(broken || ': ' || k order by r) filter (broken is not null and r <= 10), []) as fragments from q group by cmd""")
def command_fragments(spark, sf_dir):
    """A vocabulary of letter pairs, with and without a backslash, breaks most commands."""
    rows = spread_latex(spark, sf_dir)
    pairs = rows.select(F.explode(F.regexp_extract_all("latex", F.lit(r"\\?[a-z]{2}|[0-9]+"), F.lit(0))).alias("w")).groupBy("w").count().where("count > 1")
    tokens = [r.w for r in pairs.collect()]  # a vocabulary: some hundreds of letter pairs, and numbers
    return subwords.command_fragments(rows.select("latex", subwords.longest_match(F.col("latex"), tokens, 1000).alias("parts")), "latex", "parts")
