"""A corpus pipeline over ``documents``: each stage reads what its predecessor has written.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``;
the last adds each document's shard and place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from texweave.llm import decontaminate, mixing, sharding, simhash, toxicity
from texweave.llm.common import checkpoint_folder, read_table
from texweave.sources.storage import remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go.

    Null and empty texts have no passages and stay, unless labels say that texts without any are
    likelier toxic than not. Repeated rows share their fate. Labels of documents that are not
    there, null labels and null ids teach nothing; without labels of both kinds all rows share the
    smoothed share of toxic labels as score. An empty table stays empty.
    """
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id, nulls last.

    Texts without words, null ones among them, are one group. Of rows with equal ids the one with
    the smallest hash stays, of wholly equal rows one. An empty table stays empty.
    """
    return simhash.keep_one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts; documents stay, also where nothing of their text does.

    n_chars is counted anew. Null and empty texts stay as they are, repeated rows repeat, an empty
    table stays empty, and an empty benchmark changes nothing.
    """
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null texts and texts without words go: the mix takes none of their words. Rows equal in doc_id,
    source and text share one number of times. A null source is a source. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents by shard, with their shard and slot.

    All rows stay, null and empty texts among them; repeated rows get slots of their own. An empty
    table stays empty.
    """
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # what the stage has read is written anew
        before = path
    return docs


ORACLE_SQL = None  # its stages learn from labels and draw by keyed hashes: tests hold it against brute force
