"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of a word, as in ``[^\x20\x09-\x0D]+``.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and every executor can reach, below ``spark.checkpoint.dir``.

    Only a session on one machine may leave that unset; its folder is then in ``/tmp``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or "file:///tmp/glossaria-checkpoints"
    return f"{root.rstrip('/')}/glossaria-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Parquet there outlives lost executors, is compressed, and its readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """As ``materialized``, in buckets by the hash of a column: grouping by that column alone reads the rows without a shuffle.

    The catalog's entry goes at once; the files stay, as those of any external table do.
    """
    spark, name = df.sparkSession, f"glossaria_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, column).option("path", f"{shared_dir(spark)}/table").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 0, F.lit(False))
