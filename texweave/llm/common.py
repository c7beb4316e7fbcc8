"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.storage import checkpoint, checkpoint_folder  # noqa: F401  (for the operators)

STRETCH_ROWS = 4096  # rows whose sums one window runs up
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 256  # rows that travel to Python at once: with long texts, too, a batch stays small beside a worker's memory


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows. Spark reads the setting when a plan runs, so it stays in the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_batches(rows: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``rows.mapInArrow`` in bounded batches."""
    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(f, schema)


def unused(rows: DataFrame, prefix: str) -> str:
    """``prefix`` with underscores appended until no column of ``rows`` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in rows.columns):
        prefix += "_"
    return prefix


def own(rows: DataFrame) -> list[Column]:
    """All columns of ``rows``, whatever characters are in their names."""
    return [rows[f"`{c.replace('`', '``')}`"] for c in rows.columns]


def word_count(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 5; fold 0 is never trained on. A null id falls in fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1)).cast("int")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def sums_before(rows: DataFrame, keys: list[str], at: str, value: str, name: str, top: int, width: int = STRETCH_ROWS) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of equal ``keys`` with a smaller ``at``.

    ``at`` runs from 0 to ``top`` and differs within the keys. Sums run in stretches of ``width`` and then,
    in the same way, over the stretches, so that no task holds all rows of a key.
    """
    if top < width:
        past = W.partitionBy(*keys or [F.lit(0)]).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(past), F.lit(0)))
    stretch, inner, base = f"{at}_", f"{value}_", f"{name}_"
    cut = rows.withColumn(stretch, F.floor(F.col(at) / width))
    whole = cut.groupBy(*keys, stretch).agg(F.sum(value).alias(inner))
    whole = sums_before(whole, keys, stretch, inner, base, top // width, width).select(*keys, stretch, base)
    past = W.partitionBy(*keys, stretch).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    out = cut.withColumn(name, F.coalesce(F.sum(value).over(past), F.lit(0))).join(whole, [*keys, stretch])
    return out.withColumn(name, F.col(name) + F.col(base)).drop(stretch, base)
