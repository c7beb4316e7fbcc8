"""Writers and readers: what is written to the shared folder comes back as it went."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import profiles
from ..sources import readers, stages, writers
from ..sources.storage import checkpoint_folder
from .registry import query
from .views import LATEX_SQL, latex


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/written-{uuid.uuid4().hex}"


@query("""with p as (select doc_id, lang, row_number() over (order by doc_id) - 1 as idx, count(*) over () as n from documents)
  select doc_id, lang, idx, printf('train-%05d-of-%05d.parquet', idx // 300, cast(ceil(n / 300.0) as bigint)) as file from p""")
def numbered_shards(spark, sf_dir):
    path = _folder(spark)
    writers.numbered_shards(readers.table(spark, sf_dir, "documents").select("doc_id", "lang"), path, ["doc_id"], 300, "train")
    return spark.read.parquet(path).select("doc_id", "lang", "idx", F.col("_metadata.file_name").alias("file"))


@query("""select doc_id, cast(length(text) as bigint) as score, printf('s-%05d-of-%05d.parquet', (row_number() over (order by doc_id) - 1) // 400, cast(ceil(count(*) over () / 400.0) as bigint)) as file
  from documents qualify length(text) > 200""")
def scored_in_place(spark, sf_dir):
    """Shards are read, scored and filtered, and written back under their own names."""
    raw, done = _folder(spark), _folder(spark)
    writers.numbered_shards(readers.table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("score")), raw, ["doc_id"], 400, "s")
    rows = spark.read.parquet(raw).select("idx", "doc_id", "score", F.col("_metadata.file_name").alias("file"))
    writers.by_file(rows.where("score > 200"), done, "file", ["idx"])
    return spark.read.parquet(done).select("doc_id", "score", F.col("_metadata.file_name").alias("file"))


@query("select lang as subset, count(*) as n, cast(count(*) as bigint) as no_image from documents where lang in ('en', 'de') group by lang")
def subset_scan(spark, sf_dir):
    """Subsets below a folder, one of them absent, with the sample columns that their shards lack."""
    path = _folder(spark)
    rows = readers.table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("latex"))
    for lang in ("en", "de"):
        writers.by_shard(rows.where(F.col("lang") == lang).withColumn("part", F.pmod("doc_id", F.lit(3))), f"{path}/{lang}", ["part"])
    found = readers.subsets(spark, path, ["en", "absent", "de"], ["latex", "image"])
    return found.groupBy("subset").agg(F.count("*").alias("n"), F.count_if(F.col("image").isNull()).alias("no_image"))


@query("select source, count(*) as n, avg(n_chars) as mean from documents group by source")
def json_export(spark, sf_dir):
    path = _folder(spark)
    rows = readers.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.max("text").alias("_longest"))
    writers.json_rows(rows, path)
    return spark.read.schema("source string, n long, mean double").json(path)


@query("""select source, count(*) as n, avg(n_chars) as mean, 'b,c' as ran_again from documents where length(text) >= 3 group by source""")
def resumed_stages(spark, sf_dir):
    """A run that stops after its first stage, and one that goes on from there."""
    def broken(spark, rows):
        raise RuntimeError("stopped")

    first = ("a", "1", lambda spark, rows: rows.where("length(text) >= 3").select("source", "n_chars"))
    rest = [("b", "1", lambda spark, rows: rows.repartition("source")), ("c", "1", lambda spark, rows: rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")))]
    rows, folder = readers.table(spark, sf_dir, "documents"), _folder(spark)
    try:
        stages.resume(spark, rows, folder, "documents", [first, ("b", "1", broken), rest[1]])
    except RuntimeError:
        pass
    out, ran = stages.resume(spark, rows, folder, "documents", [first, *rest])
    return out.withColumn("ran_again", F.lit(",".join(ran)))


@query(f"select idx, trim(latex) as truth from {LATEX_SQL}")
def truth_annotations(spark, sf_dir):
    """The truth annotation of marked-up samples, escaped, between dollars, and after one that is no markup."""
    escaped = F.replace(F.replace(F.col("latex"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit('<ink><annotation type="truth"><math>x</math></annotation><annotation type="truth"> $'), escaped, F.lit("$\n</annotation></ink>"))
    return latex(spark, sf_dir).select("idx", readers.truth_annotation(xml).alias("truth"))


@query(rf"""select cmd as token, cast(row_number() over (order by n desc, cmd) - 1 as integer) as id from (select cmd, count(*) as n
  from (select unnest(regexp_extract_all(latex, '\\[a-zA-Z]+')) as cmd from {LATEX_SQL}) group by cmd order by n desc, cmd limit 15)""")
def vocabulary_file(spark, sf_dir):
    path = _folder(spark)
    tokens = [r.cmd for r in profiles.top_commands(latex(spark, sf_dir), "latex").collect()]  # 15 at most
    writers.save_vocabulary(spark, tokens, [], path)
    return readers.vocabulary(spark, path)
