"""Tables that outlive executors: checkpoints in the folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for what has to outlive executors: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder, which goes with the process; a
    cluster has to name one.
    """
    sc = spark.sparkContext
    if (folder := sc.getCheckpointDir()) is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="texweave-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _at(spark: SparkSession, path: str) -> tuple:
    """Spark's own file system of a path, and the path in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file systems."""
    files, target = _at(spark, path)
    files.delete(target, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    files, target = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(target))


def rename(spark: SparkSession, old: str, new: str) -> None:
    files, target = _at(spark, old)
    if not files.rename(target, _at(spark, new)[1]):
        raise OSError(f"{old} can't be renamed to {new}")


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, as a mark."""
    files, target = _at(spark, path)
    files.create(target, True).close()
