"""Samples, splits and interleaving by keyed order: the same rows on every run and in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .filters import dense_index, number_within


def keyed(key: Column, seed: int = 42) -> Column:
    """A pseudorandom order of keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def per_group(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    order = W.partitionBy(group).orderBy(keyed(F.col(key), seed), key)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def share_of_class(rows: DataFrame, group: str, key: str, where: Column, share: float, seed: int = 42) -> DataFrame:
    """Rows outside a class, and of the class an exact share (half to even) of each group."""
    marked = rows.withColumn("_in", F.coalesce(where, F.lit(False)))
    chosen = number_within(marked.where("_in").withColumn("_draw", keyed(F.col(key), seed)), [group], ["_draw", key], "_rank")
    chosen = chosen.where(F.col("_rank") < F.bround(F.col("_rank_n") * share))
    return marked.where("not _in").drop("_in").unionByName(chosen.drop("_in", "_draw", "_rank", "_rank_n"))


def exactly(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows; where there are fewer, the rows again and again until there are n."""
    chosen = rows.orderBy(keyed(F.col(key), seed), key).limit(n)
    have = chosen.count()
    if not 0 < have < n:
        return chosen
    order = W.orderBy(keyed(F.col(key), seed), key)  # fewer than n rows
    tiled = chosen.withColumn("_at", F.row_number().over(order) - 1).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(-(-n // have) - 1))))
    return tiled.where(F.col("_tile") * have + F.col("_at") < n).drop("_at", "_tile")


def file_split(rows: DataFrame, file: str, validation: int = 3, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """``rows`` with split: of a keyed share of the files the first go to validation, but never all."""
    files = rows.select(F.col(file).alias("_file")).distinct()
    ranked = files.withColumn("_rank", F.row_number().over(W.orderBy(keyed(F.col("_file"), seed), "_file")))  # one row a file
    sized = ranked.withColumn("_n", F.greatest(F.bround(F.count("*").over(W.partitionBy(F.lit(1))) * ratio), F.lit(1)))
    held = F.least(F.lit(validation), F.col("_n") - 1)
    marked = sized.where("_rank <= _n").select("_file", F.when(F.col("_rank") <= held, "validation").otherwise("train").alias("split"))
    return rows.join(marked, F.col(file) == F.col("_file")).drop("_file")


def interleave(rows: DataFrame, source: str, order: list[str], weights: dict[str, float], until: str = "all", name: str = "place") -> DataFrame:
    """``rows`` with a sort key that deals the sources by weight.

    Row k of a source stands at (k - 1/2) / weight. "all" keeps every row; "first" ends where
    the first source would run dry.
    """
    weight = F.coalesce(*(F.when(F.col(source) == k, F.lit(float(w))) for k, w in weights.items()), F.lit(1.0))
    placed = number_within(rows, [source], order, "_k").withColumn(name, (F.col("_k") + 0.5) / weight).drop("_k", "_k_n")
    if until == "all":
        return placed
    ends = placed.groupBy(source).agg(F.max(F.col(name) + 0.5 / weight).alias("_end")).agg(F.min("_end").alias("_end"))
    return placed.join(F.broadcast(ends), F.col(name) < F.col("_end")).drop("_end")  # one row


def shuffled_within(rows: DataFrame, file: str, key: str, seed: int = 42, name: str = "place") -> DataFrame:
    """``rows`` with their place in a keyed shuffle of each file."""
    out = number_within(rows.withColumn("_draw", keyed(F.col(key), seed)), [file], ["_draw", key], name)
    return out.drop("_draw", f"{name}_n")


def weighted_choice(key: Column, options: list[tuple[str, float]], seed: int = 42) -> Column:
    """One of the options by cumulative weight, from the key alone."""
    draw = F.conv(F.substring(keyed(key, seed), 1, 8), 16, 10).cast("double") / (1 << 32)
    total, upto, out = sum(w for _, w in options), 0.0, F.when(F.lit(False), F.lit(""))
    for name, w in options[:-1]:
        upto += w / total
        out = out.when(draw < upto, name)
    return out.otherwise(options[-1][0])


def minibatches(rows: DataFrame, order: list[str], key: str, size: int, drop_last: bool = False) -> DataFrame:
    """batch and keys: rows in order, ``size`` a batch."""
    placed = dense_index(rows, order, "_i").withColumn("batch", F.floor(F.col("_i") / size))
    out = placed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_i", key))).alias("_k"))
    out = out.select("batch", F.col(f"_k.{key}").alias("keys"))
    return out.where(F.size("keys") == size) if drop_last else out
