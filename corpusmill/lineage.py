"""Cutting lineage in a folder that every executor shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode, where nothing else is set."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor loses nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in whatever store it is; none if it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
