"""Packing, padding, schedules and corpus metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import evaluation, sequences
from ..sources.readers import table
from .registry import query
from .views import TURNS_SQL, turns

_TURNS = f"with p as materialized {TURNS_SQL}"


@query("""with recursive r as (select source, doc_id, least(n_chars, 20000) as size, row_number() over (partition by source order by doc_id) - 1 as k
    from documents where n_chars > 0),
  f(source, doc_id, size, k, fill, bin) as (
    select source, doc_id, size, k, size, cast(0 as bigint) from r where k = 0
    union all select r.source, r.doc_id, r.size, r.k, case when f.fill + r.size <= 20000 then f.fill + r.size else r.size end,
                     f.bin + case when f.fill + r.size <= 20000 then 0 else 1 end
    from f join r on r.source = f.source and r.k = f.k + 1)
  select source, doc_id, size as packed_size, bin from f""")
def pack_sequences(spark, sf_dir):
    return sequences.pack_greedy(table(spark, sf_dir, "documents"), "source", ["doc_id"], "n_chars", 20000)


_SIZES = "(select doc_id, list_transform(regexp_extract_all(text, '[^ \n\t]+')[1:200], lambda w: cast(length(w) as integer)) as ids from documents)"


def _word_sizes(spark, sf_dir):
    """doc_id and ids: the sizes of a text's words stand for its tokens."""
    words = F.regexp_extract_all("text", F.lit("[^ \n\t]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda w: F.length(w)).alias("ids"))


@query(f"""select doc_id, list_concat(ids, list_transform(range(0, 200 - len(ids)), lambda i: cast(0 as integer))) as input_ids,
         list_concat(list_transform(ids, lambda x: 1), list_transform(range(0, 200 - len(ids)), lambda i: cast(0 as integer))) as attention_mask,
         list_concat(ids, list_transform(range(0, 200 - len(ids)), lambda i: cast(-100 as integer))) as labels from {_SIZES}""")
def pad_mask(spark, sf_dir):
    return _word_sizes(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in sequences.padded(F.col("ids"), 200).items()))


@query(f"""select doc_id, i as position, ids[i + 2] as target from (select doc_id, ids, unnest(range(0, len(ids) - 1)) as i from {_SIZES})""")
def label_shift(spark, sf_dir):
    """Padded labels: each place predicts the next, the padding is left out."""
    labels = sequences.padded(F.col("ids"), 200)["labels"]
    rows = _word_sizes(spark, sf_dir).select("doc_id", labels.alias("labels"))
    return rows.select("doc_id", F.explode(sequences.shifted(F.col("labels"))).alias("p")).select("doc_id", "p.position", "p.target")


@query("""with e as (select event_type, event_id, value / sum(value) over (partition by event_type) as p from events where value > 0),
  c as (select *, sum(p) over (partition by event_type order by p desc, event_id rows unbounded preceding) - p as b from e)
  select event_type, event_id, round(p / sum(p) over (partition by event_type), 12) as p_kept from c where b <= 0.1""")
def nucleus_cut(spark, sf_dir):
    given = table(spark, sf_dir, "events").where("value > 0").select("event_type", "event_id", "value")
    rows = sequences.shares(given, "event_type", "value", "p").select("event_type", "event_id", "p")
    return sequences.nucleus(rows, "event_type", "event_id", "p", 0.1).select("event_type", "event_id", F.round("p_kept", 12).alias("p_kept"))


@query("""with b as (select user_id, event_id, value, min(value) over w as best from events window w as (partition by user_id order by event_id)),
  k as (select *, row_number() over (partition by user_id order by event_id) as r, lag(best) over (partition by user_id order by event_id) as e from b)
  select user_id, event_id, best, r - max(case when e is null or best < e then r end) over (partition by user_id order by event_id) as waited from k""")
def early_stopping(spark, sf_dir):
    return sequences.patience(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "best", "waited")


@query("""select step, round(case when step < 100 then 0.001 * step / 100 else 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least((step - 100) / 900.0, 1.0)))) end, 12) as lr
  from range(0, 1000) t(step)""")
def lr_schedule(spark, sf_dir):
    step = F.col("id")
    return spark.range(1000).select(step.alias("step"), F.round(M.learning_rate(step, 0.001, 100, 1000), 12).alias("lr"))


@query("select event_type, avg(value) as loss, round(exp(least(avg(value), 20)), 6) as ppl from events group by event_type")
def ppl(spark, sf_dir):
    out = evaluation.loss_summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.withColumn("ppl", F.round("ppl", 6))


@query("""select round(avg(ppl), 6) as selection from (select event_type, exp(least(avg(value / 100), 20)) as ppl from events group by event_type) where event_type <> 'click'""")
def selection_score(spark, sf_dir):
    losses = table(spark, sf_dir, "events").withColumn("loss", F.col("value") / 100)
    out = evaluation.selection_score(evaluation.loss_summary(losses, ["event_type"], "loss"), "event_type", ["click"])
    return out.select(F.round("selection", 6).alias("selection"))


@query("select source, sum(case when toxic = quality then 1 else 0 end) / count(toxic) as token_acc from documents join labels using (doc_id) group by source")
def token_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("source", (F.col("toxic") == F.col("quality")).cast("int").alias("right"), F.lit(1).alias("counted"))
    return evaluation.token_accuracy(rows, ["source"], "right", "counted")


@query(_TURNS + """ , g as (select id, truth, guess, list_distinct(list_concat(guess, truth)) as alphabet from p)
  select id, levenshtein(array_to_string(list_transform(guess, lambda x: chr(33 + cast(list_position(alphabet, x) as integer))), ''),
                         array_to_string(list_transform(truth, lambda x: chr(33 + cast(list_position(alphabet, x) as integer))), '')) as edits from g""")
def edit_distance_token(spark, sf_dir):
    return turns(spark, sf_dir).select("id", M.token_edit_distance(F.col("guess"), F.col("truth")).cast("long").alias("edits"))


@query("""select item_id, case when a = b then 0.0 else levenshtein(a, b) / greatest(length(b), 1) end as ratio from
  (select item_id, regexp_replace(text, '[^ -~]', '', 'g') as a, regexp_replace(substr(text, 11), '[^ -~]', '', 'g') as b from benchmark)""")
def edit_ratio_char(spark, sf_dir):
    plain = lambda at: F.regexp_replace(F.expr(f"substring(text, {at})"), "[^ -~]", "")
    return table(spark, sf_dir, "benchmark").select("item_id", M.char_edit_ratio(plain(1), plain(11)).alias("ratio"))


@query(_TURNS + """ , g as (select truth, guess, list_distinct(list_concat(guess, truth)) as alphabet from p),
  e as (select truth, guess, levenshtein(array_to_string(list_transform(guess, lambda x: chr(33 + cast(list_position(alphabet, x) as integer))), ''),
                         array_to_string(list_transform(truth, lambda x: chr(33 + cast(list_position(alphabet, x) as integer))), '')) as edits from g)
  select count(*) as n, avg(case when guess = truth then 1 else 0 end) as exact, round(avg(edits / greatest(len(guess), len(truth), 1)), 12) as edit from e""")
def exact_match(spark, sf_dir):
    return evaluation.match_scores(turns(spark, sf_dir), "guess", "truth").withColumn("edit", F.round("edit", 12))


@query(_TURNS + """ , o as (select unnest([1, 2, 3, 4]) as n),
  h as (select id, n, guess[i:i + n - 1] as g, count(*) as c from (select id, guess, n, unnest(range(1, len(guess) - n + 2)) as i from p, o) group by id, n, g),
  r as (select id, n, truth[i:i + n - 1] as g, count(*) as c from (select id, truth, n, unnest(range(1, len(truth) - n + 2)) as i from p, o) group by id, n, g),
  m as (select n, sum(least(h.c, r.c)) as hit from h join r using (id, n, g) group by n), s as (select n, sum(c) as total from h group by n),
  l as (select sum(len(guess)) as h, sum(len(truth)) as r from p)
  select round(exp(avg(ln(coalesce(nullif(hit, 0), 0.1) / greatest(total, 1)))) * any_value(case when l.h >= l.r then 1 else exp(1 - l.r / l.h) end), 10) as bleu
  from s left join m using (n), l""")
def bleu4(spark, sf_dir):
    return evaluation.bleu(turns(spark, sf_dir), "guess", "truth").select(F.round("bleu", 10).alias("bleu"))


@query("""select c.conv_id, c.turn, c.text = b.text as same from conversations c join (select conv_id, turn + 1 as turn, text from conversations) b using (conv_id, turn)""")
def positional_join(spark, sf_dir):
    from ..operators.joins import positional

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return positional(rows, before, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("text") == F.col("before")).alias("same"))


@query("""select path, step from (select 'step_' || event_id as path, event_id as step from events) order by step desc, path offset 3""")
def retention(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(F.concat(F.lit("step_"), F.col("event_id").cast("string")).alias("path"))
    return sequences.beyond_last(files, "path", F.regexp_extract("path", r"(\d+)$", 1).cast("long"), 3)
