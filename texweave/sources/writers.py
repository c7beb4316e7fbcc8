"""Writers: numbered shards, shards kept by name, reports, vocabularies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.filters import MOST_BROADCAST, number_within, shard_number
from .readers import exists
from .storage import checkpoint, listed, remove, rename, touch


BOUNDS_AT_ONCE = 512  # shard bounds that a row is compared with, after it has found their stretch


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer has finished the folder; what a stopped one has left goes."""
    if exists(spark, f"{path}/_SUCCESS"):
        return True
    remove(spark, path)
    return False


def numbered_shards(rows: DataFrame, path: str, order: list[str], rows_per_shard: int = 50_000, prefix: str = "part", name: str = "idx") -> int:
    """Write ``rows`` in order, with their dense number ``name``, as files ``prefix``-00000-of-000NN.parquet; returns their number.

    Bounds of the shards and counts come from the columns in ``order`` alone; whole rows are exchanged and
    written once. Rows that agree in ``order`` share a shard, so a shard is longer than ``rows_per_shard``
    only by such rows; an empty table has one empty shard. A finished folder is left alone, an unfinished one is written anew.
    """
    spark = rows.sparkSession
    if _complete(spark, path):
        return len([f for f in listed(spark, path) if f.endswith(".parquet")])
    counted = rows.groupBy(*order).agg(F.count("*").alias("_n"))
    summed = number_within(counted, [], order, "_k", {"_before": "_n"})
    key = F.struct(*order)
    firsts = summed.groupBy(shard_number(F.col("_before"), rows_per_shard).alias("_shard")).agg(F.min(F.struct(key.alias("at"), F.col("_before").alias("before"))).alias("first"))
    shard = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("first")) - 1  # one row a shard
    bounds = checkpoint(firsts.select(shard.cast("int").alias("shard"), "first"))
    n = bounds.count()
    stretches = bounds.groupBy(F.floor(F.col("shard") / BOUNDS_AT_ONCE).cast("int").alias("stretch")).agg(F.sort_array(F.collect_list("first")).alias("firsts"))
    coarse = stretches.agg(F.sort_array(F.collect_list(F.struct(F.get("firsts", F.lit(0))["at"].alias("at")))).alias("coarse"))
    below = lambda a, at: F.size(F.filter(a, lambda x: x["at"] <= at)) - 1
    tag = "_shard"
    while any(c.lower().startswith(tag) for c in rows.columns):
        tag += "_"
    keyed = rows.withColumn(f"{tag}_key", key).join(F.broadcast(coarse))  # one row
    keyed = keyed.withColumn(f"{tag}_stretch", below(F.col("coarse"), F.col(f"{tag}_key"))).drop("coarse")
    found = keyed.join(F.broadcast(stretches.select(F.col("stretch").alias(f"{tag}_of"), F.col("firsts").alias(f"{tag}_firsts"))), F.col(f"{tag}_stretch") == F.col(f"{tag}_of"))  # a row for 512 shards
    within = below(F.col(f"{tag}_firsts"), F.col(f"{tag}_key"))
    found = found.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col(f"{tag}_of") * BOUNDS_AT_ONCE + within).alias(tag), F.get(f"{tag}_firsts", within)["before"].alias(f"{tag}_base"))
    names = [f"{prefix}-{k:05d}-of-{max(n, 1):05d}.parquet" for k in range(max(n, 1))]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # rows lie in order within their shard
    placed = found.repartitionById(len(names), F.col(tag)).sortWithinPartitions(*order).withColumn(name, F.col(f"{tag}_base") + at).drop(tag, f"{tag}_base")
    _finish(placed, path, names)
    return len(names)


def _finish(placed: DataFrame, path: str, names: list[str]) -> None:
    """Write partitions as files and give each its name once all are there: a rename moves no data."""
    spark = placed.sparkSession
    placed.write.option("maxRecordsPerFile", 0).parquet(f"{path}/_writing")
    for file in listed(spark, f"{path}/_writing"):
        if file.startswith("part-"):
            rename(spark, f"{path}/_writing/{file}", f"{path}/{names[int(file.split('-')[1])]}")
    remove(spark, f"{path}/_writing")
    touch(spark, f"{path}/_SUCCESS")


def by_file(rows: DataFrame, path: str, file: str, order: list[str]) -> int:
    """Write ``rows`` back under the names of the files that they came from (column ``file``, which goes), in order; returns their number.

    What a filter or a new column makes of a folder of shards keeps its layout. Rows are exchanged and
    written once; files that keep no row go. A finished folder is left alone, an unfinished one is written anew.
    """
    spark = rows.sparkSession
    if not _complete(spark, path):
        names = sorted(r[0] for r in rows.select(file).distinct().collect())  # file names, as many as a listing of the folder has
        ids = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "_file_of string, _file_id int")
        placed = rows.join(F.broadcast(ids) if len(names) <= MOST_BROADCAST else ids, F.col(file) == F.col("_file_of"))
        _finish(placed.repartitionById(max(1, len(names)), F.col("_file_id")).sortWithinPartitions(*order).drop(file, "_file_of", "_file_id"), path, names or ["part-empty.parquet"])
    return len([f for f in listed(spark, path) if f.endswith(".parquet")])


def by_shard(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write rows under the names they came from, one folder a key.

    A key of more than the session's advisory partition size is cut into several files, each by a task of its own.
    """
    rows.hint("rebalance", *keys).write.mode("ignore").partitionBy(*keys).parquet(path)


def json_rows(rows: DataFrame, path: str) -> None:
    """One JSON object a row; columns with a leading underscore stay out."""
    rows.select(*(c for c in rows.columns if not c.startswith("_"))).write.mode("overwrite").json(path)


def report(summary: DataFrame, title: str) -> str:
    """A summary as aligned text; it is for tables that a reader takes in, and passes through the driver whole."""
    rows = [[("" if v is None else f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v)) for v in r] for r in summary.collect()]
    width = [max(map(len, column)) for column in zip(summary.columns, *rows, strict=True)]
    line = lambda cells: "  ".join(c.rjust(w) for c, w in zip(cells, width, strict=True))
    return "\n".join([title, "=" * len(title), line(summary.columns), *map(line, rows)])


def text_lines(rows: DataFrame, columns: list[str], path: str, separator: str = "\t") -> None:
    rows.select(F.concat_ws(separator, *(F.col(c).cast("string") for c in columns)).alias("value")).write.mode("overwrite").text(path)


def save_vocabulary(spark: SparkSession, tokens: list[str], merges: list[tuple[str, str]], path: str) -> None:
    """A vocabulary as one JSON file, by Spark's own file systems."""
    body = json.dumps({"token2id": {t: k for k, t in enumerate(tokens)}, "id2token": dict(enumerate(tokens)), "merges": merges}, ensure_ascii=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
