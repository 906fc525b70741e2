"""Small Spark helpers of the llm operators."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null id where ids are packed as 64-bit integers; such rows sort first.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the shared checkpoint folder; a folder of its own only in a local session that sets none.

    Spark removes shuffle files and checkpoints of tables that are no longer used when the driver collects garbage, which
    may be never in an idle heap; so it is asked to here, as the files of earlier steps have just become useless.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="talkloom-checkpoint-"))
    out = df.checkpoint()
    gc.collect()
    sc._jvm.System.gc()
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get batches of at most ``rows`` rows from the queries that end inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def smaller_batches(spark: SparkSession, rows: int) -> None:
    """From now on Python workers of this session get at most ``rows`` rows at once: for operators that are not run at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def packed_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID).cast("long"))


def unpacked_id(name: str) -> Column:
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))
