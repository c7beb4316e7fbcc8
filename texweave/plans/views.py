"""Inputs that the tables don't hold as such, in both engines: markup samples and pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.image import encode_png
from ..sources.readers import table

LATEX_SQL = r"""(select p_partkey as idx, p_brand as source, cast(p_size as bigint) * 40 as w, 10 + p_partkey % 50 as h,
  case p_partkey % 6
    when 0 then concat('\frac{', p_size, '}{', p_partkey, '}')
    when 1 then concat('\begin{pmatrix} a & ', p_size, ' \\ c & d \end{pmatrix}')
    when 2 then concat('\sum_{i=1}^{', p_size, '} x_i')
    when 3 then concat('\sqrt{', p_size)
    when 4 then 'x'
    else concat('\alpha + ', p_size, '.5 \times 10^{-', p_size, '}')
  end as latex from part)"""
TURNS_SQL = r"""(select conv_id || '-' || turn as id, conv_id, turn,
  regexp_extract_all(text, '\\[a-zA-Z]+|[^\s]') as truth,
  regexp_extract_all(lag(text) over (partition by conv_id order by turn), '\\[a-zA-Z]+|[^\s]') as guess
  from conversations qualify guess is not null)"""


def latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, source, w, h and latex: markup with all the shapes that the filters tell apart."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    text = (
        F.when(key % 6 == 0, F.concat(F.lit("\\frac{"), size, F.lit("}{"), key.cast("string"), F.lit("}")))
        .when(key % 6 == 1, F.concat(F.lit("\\begin{pmatrix} a & "), size, F.lit(" \\\\ c & d \\end{pmatrix}")))
        .when(key % 6 == 2, F.concat(F.lit("\\sum_{i=1}^{"), size, F.lit("} x_i")))
        .when(key % 6 == 3, F.concat(F.lit("\\sqrt{"), size))
        .when(key % 6 == 4, F.lit("x"))
        .otherwise(F.concat(F.lit("\\alpha + "), size, F.lit(".5 \\times 10^{-"), size, F.lit("}")))
    )
    w = (F.col("p_size").cast("long") * 40).alias("w")
    return table(spark, sf_dir, "part").select(key.alias("idx"), F.col("p_brand").alias("source"), w, (10 + key % 50).alias("h"), text.alias("latex"))


def spread_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``latex`` over as many tasks as the session shuffles by: the rows are few bytes and much work, so that a file of them is one task or two else."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return latex(spark, sf_dir).repartition(tasks, "idx")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, truth and guess: each turn's tokens and those of the turn before."""
    from pyspark.sql import Window as W

    from ..functions.text import tokens

    rows = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the rows are few bytes and much work: else adaptive plans put them together
    return rows.withColumn("_before", before).where("_before is not null").repartition(spread).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", tokens(F.col("text")).alias("truth"), tokens(F.col("_before")).alias("guess")
    )


@F.pandas_udf(T.BinaryType())
def _picture(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    kinds = np.array([[1, 0], [0, 0], [0.3, 120], [0.3, -120]])
    for keys, vectors in batches:
        out = []
        for key, vector in zip(keys, vectors, strict=True):
            gain, offset = kinds[key % 4]
            v = np.asarray(vector, np.float64) * gain
            out.append(encode_png(np.floor(np.clip((v + 1) * 127.5 + offset, 0, 255)).reshape(8, 8)))
        yield pd.Series(out)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and image: 8 x 8 grey pictures, a quarter each normal, blank, white and dark."""
    return table(spark, sf_dir, "embeddings").select("vec_id", _picture("vec_id", "embedding").alias("image"))


@F.pandas_udf(T.BinaryType())
def _sure_picture(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    middle, checks, gain = np.array([[127.5, 40, 30], [127.5, 0, 0], [250, 4, 0.9], [5, 4, 0.9]]).T
    board = np.where(np.indices((8, 8)).sum(axis=0) % 2, 1, -1)
    for kinds, vectors in batches:
        out = []
        for kind, vector in zip(kinds, vectors, strict=True):
            v = np.zeros(64)
            given = np.asarray([] if vector is None else vector, np.float64)[:64]
            v[: len(given)] = np.clip(np.nan_to_num(given), -1, 1)
            out.append(encode_png(np.floor(middle[kind] + checks[kind] * board + gain[kind] * v.reshape(8, 8))))
        yield pd.Series(out)


def sure_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and image: ``pictures`` whose kind holds whatever the vector, also a null, constant or lopsided one.

    A checkerboard gives each its spread and mean; the vector, cut to -1..1, shades it too little to change the kind.
    """
    kind = F.coalesce(F.when((F.col("vec_id") % 4).between(0, 2), F.col("vec_id") % 4), F.lit(3))
    return table(spark, sf_dir, "embeddings").select("vec_id", _sure_picture(kind, "embedding").alias("image"))


PIXELS_SQL = """(select vec_id, floor(greatest(0, least(255, (cast(v as double) * g + 1) * 127.5 + o))) as px
  from (select vec_id, unnest(embedding) as v, case vec_id % 4 when 0 then 1.0 when 1 then 0.0 else 0.3 end::double as g,
               case vec_id % 4 when 2 then 120 when 3 then -120 else 0 end::double as o from embeddings))"""
