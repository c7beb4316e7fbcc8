"""The reason-coded filter over a growing folder of samples.

The filter has no time and no state, so the stream gives the rows that a batch would; only the
running counts keep state, one row a source and reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.filters import length_reason


def sample_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def reasons(stream: DataFrame, latex: str) -> DataFrame:
    return stream.withColumn("reason", length_reason(F.col(latex)))


def running_counts(stream: DataFrame, latex: str, source: str) -> DataFrame:
    return reasons(stream, latex).groupBy(source, "reason").agg(F.count("*").alias("n"))
