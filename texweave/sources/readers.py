"""Readers: sample shards, subsets, line lists, annotation files, vocabularies."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql import Window as W

from .storage import checkpoint

MOST_BROADCAST = 100_000  # rows of a side whose count is known

SAMPLE = t.StructType([t.StructField("idx", t.LongType()), t.StructField("image", t.BinaryType()), t.StructField("latex", t.StringType()), t.StructField("source", t.StringType())])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file systems have the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, path: str, columns: list[str] | None = None, skip_corrupt: bool = False) -> DataFrame:
    """Sample shards below a path with file, the shard's name; shards without idx get null."""
    reader = spark.read.option("ignoreCorruptFiles", skip_corrupt).option("mergeSchema", True).option("recursiveFileLookup", True)
    rows = reader.parquet(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"))
    for field in SAMPLE.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return rows.select(*columns, "file") if columns else rows


def subsets(spark: SparkSession, base: str, names: list[str], columns: list[str] | None = None) -> DataFrame:
    """The subsets that exist below a folder, with subset; absent ones are skipped."""
    found = [samples(spark, f"{base}/{n}", columns).withColumn("subset", F.lit(n)) for n in names if exists(spark, f"{base}/{n}")]
    if not found:
        raise FileNotFoundError(f"none of {names} below {base}")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def resolve(spark: SparkSession, base: str, *layouts: str) -> str:
    """The first of the layouts below a folder that exists, else the folder."""
    return next((f"{base}/{x}" for x in layouts if exists(spark, f"{base}/{x}")), base)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their place in their block; a block's lines follow each other, in order."""
    block, at = None, 0
    for batch in batches:
        places = []
        for now in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            block, at = (now, 0) if now != block else (block, at + 1)
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "_at"])


def lines(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """line_no (from 0) and text of the lines of a text file, whatever its size.

    Spark reads the file in blocks. Lines are placed within their block and lifted by the lines of the blocks
    before, which are counted in a scan of their own; should the two scans not cut the file alike, the query fails.
    """
    meta = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_path", "file_block_start", "file_block_length")]
    raw = spark.read.text(path).select(F.col("value").alias(name), *meta)
    keys = [f"_{c}" for c in ("file_path", "file_block_start", "file_block_length")]
    counts = checkpoint(raw.groupBy(*keys).agg(F.count("*").alias("_n")))  # one row a block
    past = W.partitionBy("_file_path").orderBy("_file_block_start").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*keys, F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
    placed = raw.mapInArrow(_places, f"{name} string, _file_path string, _file_block_start long, _file_block_length long, _at long")
    found = placed.join(F.broadcast(before) if counts.count() <= MOST_BROADCAST else before, keys, "left")
    line = F.when(F.col("_before").isNull(), F.raise_error(F.lit("the file was cut otherwise when its lines were counted"))).otherwise(F.col("_before") + F.col("_at"))
    return found.select(line.cast("long").alias("line_no"), name)


def paired_lines(spark: SparkSession, left: str, right: str, names: tuple[str, str] = ("left", "right"), strict: bool = True) -> DataFrame:
    """Lines at the same place of two files. With ``strict`` files of different length are an error, else the longer is cut."""
    a, b = lines(spark, left, names[0]), lines(spark, right, names[1])
    if strict and a.count() != b.count():
        raise ValueError(f"{left} and {right} differ in their number of lines")
    return a.join(b, "line_no")


def row_counts(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """n, the rows below a path, from the counts in the Parquet footers: no column is read.

    Spark pushes the count into the scan of its second Parquet reader only, which is chosen for the
    time of planning. ``by`` is a partition column of the path.
    """
    name, source = "spark.sql.sources.useV1SourceList", spark.conf.get("spark.sql.sources.useV1SourceList")
    pushed = spark.conf.get("spark.sql.parquet.aggregatePushdown")
    try:
        spark.conf.set(name, ",".join(x for x in source.split(",") if x.strip() != "parquet"))
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        rows = spark.read.parquet(path)
        counted = (rows.groupBy(by) if by else rows.groupBy()).agg(F.count("*").alias("n"))
        counted._jdf.queryExecution().executedPlan()  # planned under these settings
    finally:
        spark.conf.set(name, source)
        spark.conf.set("spark.sql.parquet.aggregatePushdown", pushed)
    return counted


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, stem, length and content of the files below a folder that match a pattern; contents are read only if used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))


@F.pandas_udf(t.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def truth_annotation(xml: Column) -> Column:
    """The first truth annotation that is no MathML, without dollars and white space; null if empty."""
    found = F.regexp_extract_all(xml, F.lit(r'(?s)<annotation type="truth">(.*?)</annotation>'), F.lit(1))
    plain = F.filter(found, lambda x: ~F.contains(x, F.lit("<math")) & ~F.contains(x, F.lit("<mrow")))
    inner = F.regexp_replace(F.btrim(F.regexp_replace(F.get(plain, 0), r"(?U)^\s+|\s+$", ""), F.lit("$")), r"(?U)^\s+|\s+$", "")
    return F.nullif(unescaped(inner), F.lit(""))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token and id from a vocabulary file of either layout: {model: {vocab}} or {token2id}."""
    body = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    ids = body["model"]["vocab"] if "model" in body else body["token2id"]
    return spark.createDataFrame(sorted(ids.items(), key=lambda x: x[1]), "token string, id int")
