"""Folders that all executors share and that are removed after use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of the checkpoints; in a local session that names none, one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="talkloom-checkpoint-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A new folder, gone at the end."""
    at = f"{shared(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield at
    finally:
        delete(spark, at)


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and independent of the folders they come from."""
    shared(df.sparkSession)
    return df.checkpoint()
