"""Lookups that the ingest and the metrics need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last in order."""
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order))))
    return ranked.where("_rank = 1").drop("_rank")


def stem_join(left: DataFrame, right: DataFrame, stem: str, order: str) -> DataFrame:
    """Left rows with the last right row of their stem, and found."""
    build = last_of_each(right, stem, order).withColumn("_there", F.lit(True))
    return left.join(build, stem, "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def positional(left: DataFrame, right: DataFrame, at: str) -> DataFrame:
    """Rows at the same place of two lists; the longer list loses its end."""
    return left.join(right, at)


def present(rows: DataFrame, listing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is listed, and rows whose key is not."""
    return rows.join(listing, key, "left_semi"), rows.join(listing, key, "left_anti")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side: "missing" for keys only on the left, "extra" for keys only on the right."""
    missing = left.join(right, key, "left_anti").select(key, F.lit("missing").alias("side"))
    return missing.unionByName(right.join(left, key, "left_anti").select(key, F.lit("extra").alias("side"))).distinct()


def lookup_ids(tokens: DataFrame, token: str, vocabulary: DataFrame, unknown: int = 1) -> DataFrame:
    """``tokens`` with id from a vocabulary of token and id; unknown ones get the default."""
    vocabulary = vocabulary.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    out = tokens.join(vocabulary, F.col(token) == F.col("_token"), "left")
    return out.withColumn("id", F.coalesce("_id", F.lit(unknown))).drop("_token", "_id")


def best_rank(pairs: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """The pair of lowest merge rank of each key, the leftmost of equals."""
    ranked = pairs.join(merges, ["a", "b"])
    return ranked.groupBy(key).agg(F.min_by(F.struct("pos", "a", "b"), F.struct("rank", "pos")).alias("first"), F.min("rank").alias("rank"))


def member(value: Column, names: list[str]) -> Column:
    return value.isin(names)
