"""Source divergence audit: how the sources of a language differ in their use of words.

The corpus is counted once, by language, source and term. Each kept term of a language then is
one wide vector: an array indexed by the language's sources in order, with the count of each.
Higher-order functions turn a vector into contributions of pairs of sources, and sums that begin
in the emitting tasks add them up. A pair of sources that both lack a term differs in it by a
constant, so this constant stands once for all terms, and a vector emits only what pairs with
the term differ by from it: rare terms, which are most, cost their few sources times all.

Vectors of a language lie in ``spark.sql.shuffle.partitions`` salted parts, to each of which the
list of the language's sources travels: no task holds a language. That list is one row, and a
vector an array of as many entries: a language may have some hundred thousands of sources, though
the result has a row for each two of them anyway.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint, map_batches, utf8

STRETCH_WORDS = 1 << 22  # words that a scanning task counts at once
LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")  # on UTF-8, as all bytes of other characters are above 7F


def _tallied(groups: list[tuple[str, str]], docs: list[np.ndarray], terms: list[bytes]) -> pa.RecordBatch:
    """lang, source, term, n and docs of some documents, from the numbers of the terms of each."""
    names = {g: k for k, g in enumerate(dict.fromkeys(groups))}
    size, doc = len(terms), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    of = np.array([names[g] for g in groups], np.int64)
    each, times = np.unique(doc * size + np.concatenate(docs), return_counts=True)
    each = np.concatenate([each // size, np.arange(len(docs))]), np.concatenate([each % size, np.zeros(len(docs), np.int64)])
    cells, at = np.unique(of[each[0]] * size + each[1], return_inverse=True)
    n = np.bincount(at[: len(times)], times, len(cells)).astype(np.int64)
    listed = list(names)
    lang, source = (pa.array([g[k] for g in listed], pa.string()).take(pa.array(cells // size)) for k in (0, 1))
    term = pa.array([t.decode(errors="replace") for t in terms], pa.string()).take(pa.array(cells % size))
    return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(np.bincount(at))], ["lang", "source", "term", "n", "docs"])


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by lang, source and term of stretches of a task's documents, each of ``STRETCH_WORDS`` or a document more."""
    groups, docs, size, codes = [], [], 0, {b"": 0}
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            groups.append((lang, source))
            numbered = codes.setdefault
            docs.append(np.array([numbered(t, len(codes)) for t in _TERM.findall(utf8(text).lower())], np.int32))  # of bytes, lower changes A-Z only
            size += len(docs[-1])
            if size > STRETCH_WORDS:
                yield _tallied(groups, docs, list(codes))
                groups, docs, size, codes = [], [], 0, {b"": 0}
    if groups:
        yield _tallied(groups, docs, list(codes))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows with the term); each group has a term '' with n 0 besides."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = map_batches(docs.select(plain("lang"), plain("source"), plain("text")), _tallies, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), in decimals: counts may be large. Never null: ``total + kept`` is 0 only without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    whole = F.greatest(total + kept, F.lit(1))
    return F.lit(1).cast("long") + F.call_function("div", wide(F.lit(SCALE)) * wide(n + 1), wide(whole))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _wide(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, term and cells (source and n, by source) of the kept terms."""
    by_term = counts.where("term != ''").groupBy("lang", "term")
    wide = by_term.agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
    return wide.where(F.col("docs") >= least_docs).select("lang", "term", "cells")


def _languages(counts: DataFrame, wide: DataFrame) -> DataFrame:
    """lang, kept, total and sources: an array by source of its name, its total and its p of a term that it lacks."""
    held = wide.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(held, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    sums = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("kept"))
    both = sums.join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    lacking = lambda s, at: F.struct(at.alias("at"), s["source"].alias("source"), s["total"].alias("total"), _share(F.lit(0), s["total"], F.col("kept")).alias("p0"))
    return both.select("lang", "kept", "total", F.transform("sources", lacking).alias("sources"))


def _vectors(wide: DataFrame, languages: DataFrame, parts: int) -> DataFrame:
    """lang, term, q, and vector: by source its place, its p, its p without the term, and whether it has the term."""
    salted = languages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = wide.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).join(salted, ["lang", "salt"])
    absent = F.array_except(F.transform("sources", lambda s: s["source"]), F.transform("cells", lambda c: c["source"]))
    every = F.sort_array(F.concat("cells", F.transform(absent, lambda s: F.struct(s.alias("source"), F.lit(0).cast("long").alias("n")))))

    def cell(c: Column, s: Column) -> Column:
        p = F.when(c["n"] > 0, _share(c["n"], s["total"], F.col("kept"))).otherwise(s["p0"])
        return F.struct(s["at"].alias("at"), p.alias("p"), s["p0"].alias("p0"), (c["n"] > 0).alias("has"))

    n = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return rows.select("lang", "term", _share(n, F.col("total"), F.col("kept")).alias("q"), F.zip_with(every, "sources", cell).alias("vector"))


def _pairs(vectors: DataFrame, languages: DataFrame, parts: int) -> DataFrame:
    """lang, source, item and value of each two sources of a language, both ways."""
    one = languages.select("lang", "kept", "sources", F.explode("sources").alias("s"))
    one = one.repartition(parts, "lang", "s.at")  # a language with many sources has many rows now
    base = one.select("lang", "kept", "s", F.explode("sources").alias("t")).where("s.at != t.at")
    base = base.select(
        "lang", F.col("s.at").alias("i"), F.col("t.at").alias("j"), F.col("s.source").alias("source"), F.col("t.source").alias("item"),
        F.lit(0).cast("long").alias("value"), F.col("kept").alias("lacking"), _gap(F.col("s.p0"), F.col("t.p0")).alias("lacked"),
    )
    # Each two sources of which one has the term meet once: a source that has it, and those after it or without it.
    held = vectors.select("lang", "vector", F.explode("vector").alias("s")).where("s.has")
    after = F.filter("vector", lambda t: (t["at"] > F.col("s.at")) | (~t["has"]))
    p, q = F.col("s.p"), F.col("p")
    met = held.select("lang", F.col("s.at").alias("i"), "s", F.inline_outer(after)).where("at is not null")
    met = met.groupBy("lang", "i", F.col("at").alias("j")).agg(F.sum(_gap(p, q)).alias("there"), F.sum(_gap(q, p)).alias("back"), F.count("*").alias("n"))
    row = lambda i, j, value: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(value).alias("value"))
    both = met.select("lang", "n", F.inline(F.array(row("i", "j", "there"), row("j", "i", "back"))))  # one scan for both ways
    no_name, no_gap = (F.lit(None).cast(t) for t in ("string", "long"))
    both = both.select("lang", "i", "j", no_name, no_name, "value", -F.col("n"), no_gap)
    sums = base.union(both).groupBy("lang", "i", "j").agg(*(F.max(c).alias(c) for c in ("source", "item", "lacked")), F.sum("value").alias("value"), F.sum("lacking").alias("lacking"))
    return sums.select("lang", "source", "item", (F.col("value") + F.col("lacking") * F.col("lacked")).alias("value"))


def _ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("value"), "item")).cast("int"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank of every group of ``docs`` by language and source.

    Part ``pair``: each other source of the language and the divergence from it, summed over the terms
    that at least ``least_docs`` rows of the language have. Part ``term``: the ``top`` terms that the
    group uses more than its language does. Shares are integers in billionths with one added to
    every count, divergences floors of (p - q)^2 / q; all exact. Equal values rank by item.

    Null text, lang and source count as empty strings. Repeated rows count as often as they stand.
    A group without terms has its pairs like any other, a language with one source has none, and
    without kept terms all values are 0. Other columns of ``docs`` stay out, long texts count
    whole, and an empty table gives an empty result.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = checkpoint(term_counts(docs))
    wide = checkpoint(_wide(counts, least_docs))
    languages = checkpoint(_languages(counts, wide))
    vectors = checkpoint(_vectors(wide, languages, parts))
    pairs = _ranked(_pairs(vectors, languages, parts), ["lang", "source"])
    cells = vectors.select("lang", "term", "q", F.inline("vector")).where("has and p > q")
    terms = _ranked(cells.select("lang", "at", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")), ["lang", "at"]).where(F.col("rank") <= top)
    terms = terms.join(languages.select("lang", F.inline("sources")).select("lang", "at", "source"), ["lang", "at"])
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


ORACLE_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
e as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, cast(count(*) as hugeint) as n from e group by lang, term having count(distinct r) >= 3),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from e group by all),
v as (select lang, cast(count(*) as hugeint) as v, sum(n) as n from k group by lang),
m as (select lang, source, sum(c.n) as n from c join k using (lang, term) group by all),
x as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
             1 + (1000000000 * (cast(coalesce(c.n, 0) as hugeint) + 1)) // (cast(coalesce(m.n, 0) as hugeint) + v.v) as p,
             1 + (1000000000 * (k.n + 1)) // (cast(v.n as hugeint) + v.v) as q
      from g join k using (lang) join v using (lang) left join c using (lang, source, term) left join m using (lang, source)),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
      from x a join x b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
          from g a join g b on a.lang = b.lang and a.source != b.source
          left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
both_ as (select * from pairs union all
          select lang, source, 'term', term, cast((p - q) * (p - q) // q as bigint) from x where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from both_)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
"""
