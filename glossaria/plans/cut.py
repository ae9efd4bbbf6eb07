"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may leave that unset; it then takes a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/glossaria-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as a table to a ``scratch`` folder and read back.

    The table outlives lost executors, is computed once, and tells Spark its size, so small frontiers are broadcast.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt over four tasks a core, or the session's shuffle partitions if those are more. A small file is read by one task, whatever its rows lead to."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
