"""Resumable stages: a stopped run goes on at the last stage that was finished."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .readers import exists

Stage = tuple[str, str, Callable[[SparkSession, DataFrame], DataFrame]]


def manifest(inputs: str, stages: list[Stage]) -> list[str]:
    """A key for what each stage makes: it changes with the inputs' key, and with the name or version of the stage or of one before it."""
    keys, before = [], inputs
    for name, version, _ in stages:
        before = hashlib.sha256(f"{len(before)}:{before}{len(name)}:{name}{version}".encode()).hexdigest()
        keys.append(before)
    return keys


def resume(spark: SparkSession, rows: DataFrame, folder: str, inputs: str, stages: list[Stage]) -> tuple[DataFrame, list[str]]:
    """The result of all stages over ``rows``, and the names of those that had to run.

    A stage is (name, version, function of the session and the rows before). Each writes Parquet to
    a folder named after its key; Spark's own mark says whether it was finished. The last finished one
    is where a run begins, whatever of earlier ones is left; what a stopped stage has left is written over.
    ``inputs`` stands for the content of ``rows``, such as a version or a digest of their files.
    """
    keys = manifest(inputs, stages)
    paths = [f"{folder}/{k:02d}-{name}-{key[:16]}" for k, ((name, _, _), key) in enumerate(zip(stages, keys, strict=True))]
    done = next((k for k in reversed(range(len(paths))) if exists(spark, f"{paths[k]}/_SUCCESS")), -1)
    if done >= 0:
        rows = spark.read.parquet(paths[done])
    ran = []
    for (name, _, stage), path in list(zip(stages, paths, strict=True))[done + 1 :]:
        stage(spark, rows).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        ran.append(name)
    return rows, ran
